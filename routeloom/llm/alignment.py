"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte, and which ids go together.

Tokenizer A is a byte-level BPE (``tokenizers``) over space + text, tokenizer B a sentencepiece model over the text
(which adds the space).  A's ids come from its ranks file by ``tiktoken`` where it lies beside the vocabulary, one text
at a time: the same ids (tested against ``tokenizers``), five times faster, without an object per token.  Both sequences spell the same bytes when they round-trip; byte offsets where an A token and
a B token both end cut them into groups, and each such pair of tokens is a link.

The merge is done in lock step for a whole batch: one NumPy state vector holds the A and B pointers of every
document still open; each step compares the end offsets under the pointers, emits a link and a cut where they agree,
advances the pointer that is behind (both on a tie) and compacts the documents that are done.

Corpus-wide counts of (A id, B id) links are an aggregation with partial sums before the shuffle; a link's pair count
goes back to its document by a join that is broadcast only behind a bound on the number of distinct pairs, and
otherwise by a shuffle join.  The per-document links are written once and read twice, so texts are encoded once.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, kept, map_batches, record, utf8

#: Distinct (A id, B id) pairs up to which their counts are broadcast to the links.
BROADCAST_PAIRS = 2_000_000
#: Packs an (A id, B id) pair into one long.
SHIFT = 32
#: Tokens whose group strings are laid out at once, about; a longer document is laid out whole.
GROUP_TOKENS = 1 << 17
#: Documents encoded and merged at once: bounds a worker's memory to so many texts' tokens.
DOCS = 250


def _byte_decoder() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 onwards, in byte order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars, extra = {}, 0
    for b in range(256):
        if b in printable:
            chars[chr(b)] = b
        else:
            chars[chr(256 + extra)] = b
            extra += 1
    return chars


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces as one byte array and where each begins (one more than pieces)."""
    starts = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=starts[1:])
    return np.frombuffer(b"".join(pieces), np.uint8), starts


class Tokenizers:
    """Both tokenizers, and the bytes of every id of each."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # A's entries from the vocabulary file itself, byte-level decoded; added tokens are their text
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"])
        added = {t["content"] for t in spec.get("added_tokens", [])}
        vocab.update({t["content"]: t["id"] for t in spec.get("added_tokens", [])})
        del spec
        decoder = _byte_decoder()
        a_pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_pieces[i] = token.encode() if token in added else bytes(decoder[c] for c in token)
        # the same ranks read by tiktoken encode A without the objects of each token; ids are equal (tested)
        self.fast_a = None
        ranks_file = a_path.rsplit(".", 1)[0] + ".tiktoken"
        if not os.path.exists(ranks_file):
            self.a = Tokenizer.from_file(a_path)
            self.a.encode_special_tokens = True  # their strings inside texts are plain text
        else:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.fast_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b_pieces = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_pieces.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_bytes, self.a_starts = _table(a_pieces)
        self.b_bytes, self.b_starts = _table(b_pieces)
        self.a_len, self.b_len = np.diff(self.a_starts), np.diff(self.b_starts)
        self.digit_bytes, self.digit_starts = _table([str(i).encode() for i in range(len(a_pieces))] + [str(i).encode() for i in range(len(b_pieces))])
        self.digit_len = np.diff(self.digit_starts)

    def encode_a(self, text: str) -> list[int]:
        """A's ids of one text, special strings as plain text."""
        if self.fast_a is not None:
            return self.fast_a.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _LOADED:
        _LOADED[(a_path, b_path)] = Tokenizers(a_path, b_path)
    return _LOADED[(a_path, b_path)]


def _gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of ``ids`` one after another."""
    n = lengths[ids]
    total = int(n.sum())
    if not len(ids) or not total:
        return np.zeros(0, np.uint8)
    # positions fit 32 bits: a table of pieces and the bytes of one batch
    kind = np.int32 if total < 1 << 31 and len(table) < 1 << 30 else np.int64
    begin = np.repeat((starts[ids] - np.concatenate([[0], np.cumsum(n)[:-1]])).astype(kind), n)
    begin += np.arange(total, dtype=kind)
    return table[begin]


def _spelled(ids: np.ndarray, first: np.ndarray, table, starts, lengths, data, offsets) -> np.ndarray:
    """Per document: whether its tokens spell exactly its bytes."""
    n_docs = len(offsets) - 1
    per_doc = np.add.reduceat(np.concatenate([lengths[ids], [0]]), first[:-1]) if len(ids) else np.zeros(n_docs, np.int64)
    per_doc = np.where(np.diff(first) > 0, per_doc, 0)
    same = per_doc == np.diff(offsets)
    got = _gather(table, starts, lengths, ids)
    if len(got) == len(data):
        wrong = np.flatnonzero(got != data)
        same[np.searchsorted(offsets, wrong, side="right") - 1] = False
    else:  # some document's length differs: compare those that agree, one by one
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])[first]
        for d in np.flatnonzero(same):
            same[d] = np.array_equal(got[ends[d] : ends[d + 1]], data[offsets[d] : offsets[d + 1]])
    return same


def lockstep(a_ends: np.ndarray, a_first: np.ndarray, b_ends: np.ndarray, b_first: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked A and B tokens of ``docs``, in order; ends are offsets within each document.

    One state vector of pointers advances all documents at once; a step emits the links of the documents whose two
    tokens end together and drops those that are done.
    """
    ia, ib, stop = a_first[docs].copy(), b_first[docs].copy(), a_first[docs + 1]
    alive = ia < stop
    ia, ib, stop = ia[alive], ib[alive], stop[alive]
    found_a, found_b = [], []
    while len(ia):
        ea, eb = a_ends[ia], b_ends[ib]
        tie = ea == eb
        found_a.append(ia[tie])
        found_b.append(ib[tie])
        ia = ia + (ea <= eb)
        ib = ib + (eb <= ea)
        alive = ia < stop
        if not alive.all():
            ia, ib, stop = ia[alive], ib[alive], stop[alive]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    la, lb = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(la, kind="stable")
    return la[order], lb[order]


def _groups_text(t: Tokenizers, a_ids, b_ids, a_doc, b_doc, a_group, b_group, n_docs) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document, hashed; '' for documents without tokens.

    The text of a whole batch is laid out as one byte array (decimal digits of each id, then its separator), so no
    object is made per token.
    """
    doc = np.concatenate([a_doc, b_doc]).astype(np.int32)
    group = np.concatenate([a_group, b_group]).astype(np.int32)
    side = np.concatenate([np.zeros(len(a_doc), np.int8), np.ones(len(b_doc), np.int8)])
    position = np.concatenate([np.arange(len(a_doc), dtype=np.int32), np.arange(len(b_doc), dtype=np.int32)])
    order = np.lexsort((position, side, group, doc))
    doc, group, side = doc[order], group[order], side[order]
    # digits of each id: B's follow A's in one table
    ids = np.concatenate([a_ids, b_ids + len(t.a_len)]).astype(np.int32)[order]
    nxt = np.ones(len(doc), bool)
    nxt[:-1] = (doc[1:] == doc[:-1]) & (group[1:] == group[:-1]) & (side[1:] == side[:-1])
    nxt[-1:] = False
    last_of_doc = np.ones(len(doc), bool)
    last_of_doc[:-1] = doc[1:] != doc[:-1]
    sep = np.full(len(doc), ord(";"), np.uint8)
    sep[side == 0] = ord("|")
    sep[nxt] = ord(",")
    has_sep = ~((side == 1) & last_of_doc)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    digests = [""] * n_docs
    # whole documents at a time, about GROUP_TOKENS tokens, so that the byte arrays stay small
    d = 0
    while d < n_docs:
        e = max(d + 1, int(np.searchsorted(first, first[d] + GROUP_TOKENS, side="right")) - 1)
        e = min(e, n_docs)
        lo, hi = first[d], first[e]
        if hi > lo:
            part, digits = ids[lo:hi], t.digit_len[ids[lo:hi]]
            begin = np.concatenate([[0], np.cumsum(digits + has_sep[lo:hi])])
            out = np.empty(int(begin[-1]), np.uint8)
            out[np.repeat(begin[:-1], digits) + (np.arange(digits.sum()) - np.repeat(np.cumsum(digits) - digits, digits))] = _gather(t.digit_bytes, t.digit_starts, t.digit_len, part)
            out[(begin[:-1] + digits)[has_sep[lo:hi]]] = sep[lo:hi][has_sep[lo:hi]]
            bounds = begin[first[d : e + 1] - lo]
            for k, (s_, e_) in enumerate(zip(bounds[:-1], bounds[1:])):
                if e_ > s_:
                    digests[d + k] = hashlib.sha256(out[s_:e_]).hexdigest()
        d = e
    return digests


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """__row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs (A id << 32 | B id of each link) of each row.

    Null and empty texts, and texts whose A or B tokens do not spell space + text, have no tokens: zeros, '' and no
    pairs.  Repeated rows give repeated rows.
    """

    def smaller(batches: Batches) -> Batches:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                yield batch.slice(start, DOCS)

    def work(batches: Batches) -> Batches:
        t = tokenizers(a_path, b_path)
        for batch in smaller(batches):
            texts = batch.column("text").fill_null("").to_pylist()
            n = len(texts)
            spaced = [" " + x for x in texts]
            data, offsets = utf8(pa.array(spaced, pa.large_string()))
            a_lists = [np.asarray(t.encode_a(x), np.int64) for x in spaced]
            b_lists = [np.asarray(x, np.int64) for x in t.b.encode(texts)] if n else []
            a_first = np.zeros(n + 1, np.int64)
            np.cumsum([len(x) for x in a_lists], out=a_first[1:])
            b_first = np.zeros(n + 1, np.int64)
            np.cumsum([len(x) for x in b_lists], out=b_first[1:])
            a_ids = np.concatenate(a_lists) if n else np.zeros(0, np.int64)
            b_ids = np.concatenate(b_lists) if n else np.zeros(0, np.int64)
            ok = (np.array([len(x) for x in texts]) > 0) if n else np.zeros(0, bool)
            ok &= _spelled(a_ids, a_first, t.a_bytes, t.a_starts, t.a_len, data, offsets)
            ok &= _spelled(b_ids, b_first, t.b_bytes, t.b_starts, t.b_len, data, offsets)
            # keep the tokens of documents that round-trip
            a_doc = np.repeat(np.arange(n), np.diff(a_first))
            b_doc = np.repeat(np.arange(n), np.diff(b_first))
            ka, kb = ok[a_doc], ok[b_doc]
            a_ids, a_doc, b_ids, b_doc = a_ids[ka], a_doc[ka], b_ids[kb], b_doc[kb]
            a_first = np.searchsorted(a_doc, np.arange(n + 1))
            b_first = np.searchsorted(b_doc, np.arange(n + 1))
            # end offsets within each document
            a_ends = np.cumsum(t.a_len[a_ids]) - np.repeat(np.concatenate([[0], np.cumsum(t.a_len[a_ids])])[a_first[:-1]], np.diff(a_first))
            b_ends = np.cumsum(t.b_len[b_ids]) - np.repeat(np.concatenate([[0], np.cumsum(t.b_len[b_ids])])[b_first[:-1]], np.diff(b_first))
            la, lb = lockstep(a_ends, a_first, b_ends, b_first, np.flatnonzero(ok))
            link_doc = a_doc[la]
            n_links = np.bincount(link_doc, minlength=n).astype(np.int64)
            # a token's group is the number of links before it in its document
            a_group = np.searchsorted(la, np.arange(len(a_ids))) - np.searchsorted(la, a_first[a_doc])
            b_group = np.searchsorted(lb, np.arange(len(b_ids))) - np.searchsorted(lb, b_first[b_doc])
            digests = _groups_text(t, a_ids, b_ids, a_doc, b_doc, a_group, b_group, n)
            pairs = (a_ids[la] << SHIFT) | b_ids[lb]
            link_first = np.searchsorted(link_doc, np.arange(n + 1))
            yield record(
                __row=batch.column("__row"),
                doc_id=batch.column("doc_id"),
                n_a=np.diff(a_first).astype(np.int64),
                n_b=np.diff(b_first).astype(np.int64),
                n_groups=n_links,
                n_links=n_links,
                groups_sha256=pa.array(digests, pa.string()),
                pairs=pa.ListArray.from_arrays(pa.array(link_first.astype(np.int32)), pa.array(pairs, pa.int64())),
            )

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "text")
    schema = "__row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>"
    return map_batches(rows, work, schema)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (bigint) and groups_sha256 of every row of ``docs``.

    A pair's count is how many links of the whole table join its A and B ids; n_best counts the links whose pair has
    the highest count of all pairs of its B id (ties all count), count_sum adds the counts of a document's links.
    Texts as in ``links``; null doc_ids stay null; repeated rows count and come out repeated; other columns are not
    carried.  No rows give no rows.
    """
    each = kept(links(docs, a_path, b_path), "links")
    flat = each.select("__row", F.explode("pairs").alias("pair"))
    counts = flat.groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    high = counts.groupBy("b").agg(F.max("count").alias("high"))
    scored = kept(counts.join(high, "b").select("pair", "count", (F.col("count") == F.col("high")).cast("bigint").alias("best")), "pairs")
    small = scored.count() <= BROADCAST_PAIRS
    per_doc = flat.join(F.broadcast(scored) if small else scored, "pair").groupBy("__row").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    out = each.join(per_doc, "__row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
