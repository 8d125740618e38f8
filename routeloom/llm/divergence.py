"""Source divergence audit: how far each source's term distribution stands from the others of its language.

Terms are runs of characters other than ASCII non-letters, with A-Z lower-cased.  Each language keeps the terms that are
in at least ``min_docs`` of its documents.  The kept terms of a language become a minimal acyclic transducer over UTF-8
bytes, built from the sorted terms by the incremental algorithm for sorted input: its outputs along a path add up to
the term's lexicographic ordinal.  Texts are streamed through the transducers of their languages, the distinct terms of a
batch in lock step, to recount the kept terms per (language, source) as (ordinal, count); ordinals break ties in byte order.

Smoothed probabilities are integers, ``p = 1 + floor(1e9 * (count + 5) / (N + 5 V))``, exact in longs.  Part ``pair``
sums ``|p - q|`` over all kept terms for each other source of the language: the kept terms of a language are cut into
blocks of ordinals, a task sums one block for all pairs of its sources (absent terms at the source's constant), and
the blocks' sums are added up.  Part ``term`` lists terms where a source's p exceeds its language's, the 50 largest
per source.  Terms are found by byte classes in NumPy, on UTF-8 the same runs as the pattern, and grouped by 64-bit keys that
are checked against all bytes.  A task adds up its batches, within a bound on rows, before it gives any out.

Document frequencies and counts are aggregations with partial sums before the shuffle; a hot source or language is
one key of an aggregation, never one task's rows.  The transducers are built one language a task and broadcast
behind a bound on their bytes; past it the counts come from a join of the exploded terms with the vocabulary
instead, with the same result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, kept, map_batches, mixed, record, utf8

# fixed values of the contract: terms, the letters that are lower-cased, the smoothing and the scale
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ADD = 5
SCALE = 1_000_000_000

MIN_DOCS = 30
TOP = 50
#: Bytes of all transducers together that may be broadcast; past it the counts come by join.
BROADCAST_BYTES = 256 << 20


def transducer(terms: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of sorted, distinct byte strings: transitions keyed by state * 256 + byte.

    ``keys`` are sorted; ``targets`` and ``weights`` go with them; the weights along a path add up to the ordinal of
    the term it spells; ``final`` tells the states where a term ends.  The root is state 0.
    """
    trans: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    unchecked: list[tuple[int, int, int]] = []
    previous = b""

    def minimize(down_to: int) -> None:
        while len(unchecked) > down_to:
            parent, label, child = unchecked.pop()
            signature = (final[child], tuple(trans[child].items()))
            same = register.get(signature)
            if same is None:
                register[signature] = child
            else:
                trans[parent][label] = same

    for term in terms:
        if term <= previous and previous:
            raise ValueError("terms must be sorted and distinct")
        common = 0
        for a, b in zip(term, previous):
            if a != b:
                break
            common += 1
        minimize(common)
        node = unchecked[-1][2] if unchecked else 0
        for label in term[common:]:
            trans.append({})
            final.append(False)
            trans[node][label] = len(trans) - 1
            unchecked.append((node, label, len(trans) - 1))
            node = len(trans) - 1
        final[node] = True
        previous = term
    minimize(0)

    # the states reached from the root, in the order of a depth-first walk; counts of terms below each, after its children
    number: dict[int, int] = {0: 0}
    order, stack = [0], [0]
    while stack:
        s = stack.pop()
        for t in trans[s].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
                stack.append(t)
    below = {}
    for s in _post_order(trans):
        below[s] = int(final[s]) + sum(below[t] for t in trans[s].values())
    keys, targets, weights = [], [], []
    for s in order:
        running = int(final[s])
        for label, t in trans[s].items():
            keys.append(number[s] * 256 + label)
            targets.append(number[t])
            weights.append(running)
            running += below[t]
    k = np.array(keys, np.int64)
    sort = np.argsort(k, kind="stable")
    return {
        "keys": k[sort],
        "targets": np.array(targets, np.int64)[sort],
        "weights": np.array(weights, np.int64)[sort],
        "final": np.array([final[s] for s in order], bool),
        "longest": np.int64(max((len(t) for t in terms), default=0)),
    }


def _post_order(trans: list[dict[int, int]]) -> list[int]:
    """States reachable from the root, each after all states it leads to."""
    seen, out, stack = {0}, [], [(0, iter(trans[0].values()))]
    while stack:
        s, children = stack[-1]
        for t in children:
            if t not in seen:
                seen.add(t)
                stack.append((t, iter(trans[t].values())))
                break
        else:
            stack.pop()
            out.append(s)
    return out


def with_table(fst: dict[str, np.ndarray], most: int) -> dict[str, np.ndarray]:
    """With transitions by state and class of byte (the bytes in use, and one class for all others), -1 where there is none.

    A table of more than ``most`` bytes is left out; transitions are then searched for.
    """
    labels = np.unique(fst["keys"] & 255)
    width = len(labels) + 1
    if len(fst["final"]) * width * 4 > most:
        return fst
    classes = np.full(256, len(labels), np.int64)
    classes[labels] = np.arange(len(labels))
    table = np.full(len(fst["final"]) * width, -1, np.int32)
    table[(fst["keys"] >> 8) * width + classes[fst["keys"] & 255]] = np.arange(len(fst["keys"]), dtype=np.int32)
    return fst | {"table": table, "classes": classes, "width": np.int64(width)}


def ordinals(fst: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ordinal of each byte string data[starts:ends] in the transducer, -1 where it is not a term; all in lock step."""
    n = len(starts)
    out = np.full(n, -1, np.int64)
    keys, targets, weights = fst["keys"], fst["targets"], fst["weights"]
    if n == 0 or len(keys) == 0:
        return out
    longest = fst["longest"] if "longest" in fst else np.iinfo(np.int64).max
    alive = np.flatnonzero((ends > starts) & (ends - starts <= longest))  # longer strings are no term
    state = np.zeros(len(alive), np.int64)
    total = np.zeros(len(alive), np.int64)
    step = 0
    while len(alive):
        done = ends[alive] - starts[alive] == step
        if done.any():
            ok = done & fst["final"][state]
            out[alive[ok]] = total[ok]
            keep = ~done
            alive, state, total = alive[keep], state[keep], total[keep]
            if not len(alive):
                break
        label = data[starts[alive] + step]
        if "table" in fst:
            at = fst["table"][state * fst["width"] + fst["classes"][label]]
            hit = at >= 0
        else:
            key = state * 256 + label
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
        alive, state, total, at = alive[hit], state[hit], total[hit], at[hit]
        state = targets[at]
        total = total + weights[at]
        step += 1
    return out


def _pack(fst: dict[str, np.ndarray]) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **fst)
    return buffer.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


#: Bytes that belong to terms, letters of ASCII (lower-cased) and every byte of a character outside ASCII; others are 0.
_LOWERED = np.zeros(256, np.uint8)
_LOWERED[0x61:0x7B] = _LOWERED[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWERED[0x80:] = np.arange(0x80, 0x100)
#: Rows that a task adds up before it gives them out, a bound on its memory.
HELD = 1 << 19
#: Bytes of the transition tables of a task, all languages together.
TABLE_BYTES = 64 << 20
#: Kept terms of a language per task of the pair part.
BLOCK_TERMS = 4096


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts (0 outside terms), and start, end and text of every term; null is empty.

    A term is a run of bytes of letters and of characters outside ASCII, which on UTF-8 is the runs of the pattern.
    """
    data, offsets = utf8(texts)
    data = _LOWERED[data]
    term = data != 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = term[:-1], term[1:]
    own = offsets[1:] > offsets[:-1]
    before[offsets[:-1][own]] = False
    after[offsets[1:][own] - 1] = False
    starts = np.flatnonzero(term > before)
    ends = np.flatnonzero(term > after) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number; zeros follow the data."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def term_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each term: its bytes, or of more than eight bytes a hash, eight bytes at a time."""
    length = ends - starts
    keys = words[starts] & _MASKS[np.minimum(length, 8)]
    open_ = np.flatnonzero(length > 8)
    done = 8
    while len(open_):
        part = words[starts[open_] + done] & _MASKS[np.minimum(length[open_] - done, 8)]
        keys[open_] = mixed(keys[open_] * _STEP + part)
        done += 8
        open_ = open_[length[open_] > done]
    return keys


def _alike(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> bool:
    """Whether each term that has over eight bytes equals the term at ``others`` byte by byte, and the rest have its length."""
    length = ends - starts
    if not (length == length[others]).all():
        return False
    open_ = np.flatnonzero(length > 8)
    done = 0
    while len(open_):
        mask = _MASKS[np.minimum(length[open_] - done, 8)]
        if (((words[starts[open_] + done] ^ words[starts[others[open_]] + done]) & mask) != 0).any():
            return False
        done += 8
        open_ = open_[length[open_] > done]
    return True


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of each distinct term, and which of them each term is; terms are compared by all their bytes."""
    words = _words(data)
    code, _ = pd.factorize(term_keys(words, starts, ends))
    first = _firsts(code)
    if not _alike(words, starts, ends, first[code]):  # two terms share a key: by their bytes instead
        code, _ = pd.factorize(np.array([data[a:b].tobytes() for a, b in zip(starts, ends)], object))
        first = _firsts(code)
    return first, code


def _firsts(code: np.ndarray) -> np.ndarray:
    first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each comes."""
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(at, append=len(values))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The terms as an Arrow column."""
    to = np.concatenate([[0], np.cumsum(ends - starts)])
    raw = data[np.repeat(starts - to[:-1], ends - starts) + np.arange(to[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def _added(parts: Iterator[pa.RecordBatch], key: list[str], n: str) -> Iterator[pa.Table]:
    """``parts`` with ``n`` summed per key over as many as stay within HELD rows."""
    held, rows = [], 0

    def merged() -> pa.Table:
        return pa.Table.from_batches(held).group_by(key, use_threads=False).aggregate([(n, "sum")]).rename_columns([*key, n])

    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= HELD:
            whole = merged()
            if whole.num_rows > HELD // 2:
                yield whole
                held, rows = [], 0
            else:
                held, rows = whole.to_batches(), whole.num_rows
    if held:
        yield merged()
    held = []
    pa.default_memory_pool().release_unused()  # workers are used again, and idle ones would keep it beside the JVM


def terms_of(docs: DataFrame) -> DataFrame:
    """lang, source ('' for null), text ('' for null): what the passes read."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").alias("text"))


def _document_frequencies(terms: DataFrame) -> DataFrame:
    """lang, term, docs: in how many documents of the language each term is, summed from the counts of each batch."""

    def each_batch(batches: Batches) -> Batches:
        for batch in batches:
            data, starts, ends, doc = tokens(batch.column("text"))
            first, code = distinct(data, starts, ends)
            n_terms = max(len(first), 1)
            langs = batch.column("lang").dictionary_encode()
            # one row per distinct (document, term), counted by (language, term)
            pairs, _ = _runs(doc * n_terms + code)
            key, n = _runs(langs.indices.to_numpy()[pairs // n_terms].astype(np.int64) * n_terms + pairs % n_terms)
            which = first[key % n_terms]
            yield record(lang=langs.dictionary.take(pa.array(key // n_terms)).cast(pa.string()), term=_strings(data, starts[which], ends[which]), docs=n.astype(np.int64))

    def work(batches: Batches) -> Batches:
        for part in _added(each_batch(batches), ["lang", "term"], "docs"):
            yield from part.to_batches()

    each = map_batches(terms.select("lang", "text"), work, "lang string, term string, docs bigint")
    return each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(terms: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, ordinal (from 0, UTF-8 byte order within the language): terms in at least min_docs documents."""
    kept_terms = _document_frequencies(terms).where(F.col("docs") >= min_docs).select("lang", "term")
    return kept_terms.withColumn("ordinal", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("term").cast("binary"))) - 1)


def _built(vocab: DataFrame) -> DataFrame:
    """One row per language: its transducer as bytes, built in one task per language from its sorted terms."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        words = sorted(t.encode() for t in rows["term"])
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "fst": [_pack(transducer(words))], "n_terms": [len(words)]})

    return vocab.groupBy("lang").applyInPandas(build, "lang string, fst binary, n_terms bigint")


def _joined_counts(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same counts by a join of every term occurrence with the vocabulary, for transducers too large to send."""
    lowered = F.translate("text", UPPER, LOWER)
    exploded = terms.select("lang", "source", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), 0)).alias("term"))
    return exploded.join(vocab, ["lang", "term"]).groupBy("lang", "source", "ordinal").agg(F.count(F.lit(1)).alias("count"))


def counts(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """lang, source, ordinal, count (> 0) of the kept terms, by streaming texts through the transducers."""
    spark = terms.sparkSession
    built = kept(_built(vocab), "transducers")
    size = built.select(F.sum(F.length("fst"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _joined_counts(terms, vocab)
    machines = spark.sparkContext.broadcast({r.lang: bytes(r.fst) for r in built.collect()})

    def work(batches: Batches) -> Batches:
        loaded: dict[str, dict] = {}
        groups: dict[tuple[str, str], int] = {}  # numbers of the (language, source) of this task
        room = TABLE_BYTES

        def each_batch() -> Batches:
            nonlocal room
            for batch in batches:
                data, starts, ends, doc = tokens(batch.column("text"))
                first, code = distinct(data, starts, ends)
                n_terms = max(len(first), 1)
                langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
                group = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources)], np.int64)
                # the distinct terms of each group and how often each comes; the machine of the language tells their ordinals
                key, n = _runs(group[doc] * n_terms + code)
                of_group, of_term = key // n_terms, key % n_terms
                lang_of = dict(zip(group.tolist(), langs))
                for lang in set(langs) & machines.value.keys():
                    if lang not in loaded:
                        loaded[lang] = with_table(_unpack(machines.value[lang]), room)
                        room -= loaded[lang]["table"].nbytes if "table" in loaded[lang] else 0
                    mine = np.flatnonzero(np.isin(of_group, [g for g, own in lang_of.items() if own == lang]))
                    asked, back = np.unique(of_term[mine], return_inverse=True)
                    at = first[asked]
                    found = ordinals(loaded[lang], data, starts[at], ends[at])[back]
                    good = found >= 0
                    yield record(group=of_group[mine][good], ordinal=found[good], count=n[mine][good].astype(np.int64))

        for part in _added(each_batch(), ["group", "ordinal"], "count"):
            names = list(groups)
            which = part["group"].combine_chunks()
            lang, source = (pa.array([g[k] for g in names], pa.string()).take(which) for k in (0, 1))
            yield record(lang=lang, source=source, ordinal=part["ordinal"].combine_chunks(), count=part["count"].combine_chunks())

    each = map_batches(terms, work, "lang string, source string, ordinal bigint, count bigint")
    return each.groupBy("lang", "source", "ordinal").agg(F.sum("count").alias("count"))


def _pair_sums(nz: DataFrame, totals: DataFrame, width: int = BLOCK_TERMS) -> DataFrame:
    """lang, a, b, value: sum over all kept terms of |p_a - p_b| for every two sources of a language.

    Kept terms of a language are cut into blocks of ``width`` ordinals; a task takes one block with every source of
    the language (absent terms at the source's constant) and adds up the differences of all its pairs.
    """
    blocks = totals.where("V > 0").select("lang", "source", "c", F.explode(F.sequence(F.lit(0), ((F.col("V") - 1) / width).cast("int"))).alias("block"))
    marks = blocks.select("lang", "block", "source", F.lit(-1).cast("bigint").alias("ordinal"), F.col("c").alias("p"))
    present = nz.select("lang", (F.col("ordinal") / width).cast("int").alias("block"), "source", "ordinal", "p")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        sources = sorted(rows.loc[rows["ordinal"] < 0, "source"].unique(), key=lambda x: x.encode())
        where = {x: i for i, x in enumerate(sources)}
        const = rows[rows["ordinal"] < 0].drop_duplicates("source").set_index("source")["p"]
        terms = rows[rows["ordinal"] >= 0]
        low = int(rows["block"].iloc[0]) * width
        span = int(terms["ordinal"].max()) - low + 1 if len(terms) else 0
        matrix = np.repeat(np.array([const[x] for x in sources], np.int64)[:, None], span, axis=1)
        matrix[terms["source"].map(where).to_numpy(), terms["ordinal"].to_numpy() - low] = terms["p"].to_numpy()
        out_a, out_b, out_v = [], [], []
        for i, x in enumerate(sources):
            sums = np.abs(matrix - matrix[i]).sum(axis=1)
            out_a += [x] * len(sources)
            out_b += sources
            out_v.append(sums)
        value = np.concatenate(out_v) if out_v else np.zeros(0, np.int64)
        frame = pd.DataFrame({"lang": rows["lang"].iloc[0], "a": out_a, "b": out_b, "value": value})
        return frame[frame["a"] != frame["b"]]

    each = present.unionByName(marks).groupBy("lang", "block").applyInPandas(work, "lang string, a string, b string, value bigint")
    return each.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value (bigint), rank (int) of every (lang, source) group of ``docs``.

    Null text, lang and source read as ''.  A group without kept terms still has its pair rows; a language without
    kept terms gives value 0 to every pair and no term rows; a language of one source has no pair rows.  Ties of
    value are broken by item in UTF-8 byte order, so ranks run 1, 2, 3 without gaps.  Repeated rows count as
    documents.  No rows give no rows.  Other columns of ``docs`` are not read.
    """
    terms = terms_of(docs)  # read twice, by the vocabulary and by the recount, rather than stored
    vocab = kept(vocabulary(terms, min_docs), "vocabulary")
    found = kept(counts(terms, vocab), "counts")

    groups = terms.select("lang", "source").distinct()
    v = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("V"))
    totals = groups.join(found.groupBy("lang", "source").agg(F.sum("count").alias("N")), ["lang", "source"], "left")
    totals = totals.join(v, "lang", "left").fillna(0, ["N", "V"])

    def p(count: str) -> F.Column:
        # exact: integer division of longs
        return F.expr(f"CASE WHEN N + {ADD} * V > 0 THEN 1 + (CAST({SCALE} AS BIGINT) * ({count} + {ADD})) div (N + {ADD} * V) END")

    totals = kept(totals.withColumn("c", p("0")), "totals")  # the p of a term not there
    nz = kept(found.join(totals, ["lang", "source"]).select("lang", "source", "ordinal", "count", p("count").alias("p")), "present")

    # part term: against the language as a whole
    of_lang = found.groupBy("lang", "ordinal").agg(F.sum("count").alias("count"))
    lang_totals = of_lang.groupBy("lang").agg(F.sum("count").alias("N")).join(v, "lang")
    lang_p = of_lang.join(lang_totals, "lang").select("lang", "ordinal", p("count").alias("q"))
    above = nz.join(lang_p, ["lang", "ordinal"]).where("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("ordinal"))
    best = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    term_rows = best.join(vocab, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.col("rank").cast("int"))

    # part pair: every other source of the language, the sum over all kept terms by blocks of terms
    a = totals.select("lang", F.col("source").alias("a"))
    b = totals.select("lang", F.col("source").alias("b"))
    pairs = a.join(b, "lang").where("a != b")  # the rows of the result
    whole = pairs.join(_pair_sums(nz, totals), ["lang", "a", "b"], "left").fillna(0, ["value"])
    value = F.col("value").cast("bigint")
    by_pair = Window.partitionBy("lang", "a").orderBy(F.col("value").desc(), F.col("b").cast("binary"))
    pair_rows = whole.select("lang", "a", "b", value.alias("value")).withColumn("rank", F.row_number().over(by_pair).cast("int"))
    pair_rows = pair_rows.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", "rank")
    return pair_rows.unionByName(term_rows)
