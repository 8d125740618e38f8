"""Near-duplicate join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

MinHash signatures are cut into bands, as many of as many rows as reach the target recall at the threshold; documents
that share a band hash are candidates.  Documents of equal sets are one text with copies from the start.  Candidates
that hang together by bands form a group, whose full sets are sent once to a task, where every pair is verified by
counting common n-grams; the pairs themselves never become rows.  A large group is cut into blocks of a set size, and
each two blocks meet in a task of their own.  Tasks return, per text, how many others it is linked to and the least text
that it hangs together with there, from which classes follow over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEYS, Batches, kept, keyed, map_batches, mixed, only, record, text_of
from .words import Words, words

#: Texts of a block of a large group.
BLOCK = 512

#: n-grams hashed at a time, so that what is worked on stays in the processor's cache.
_SLICE = 1 << 15


def bands_for(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall within ``most`` hashes."""
    found = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            found = bands, rows
    if found is None:
        raise ValueError("no banding within so many hashes reaches this recall")
    return found


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of the distinct n-grams of each text, by text; fewer words than n are one n-gram."""
    at, h = w.grams(n)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.zeros(len(short), np.uint64)
    for i in range(n - 1):
        here = count[short] > i
        whole[here] = mixed(whole[here] * np.uint64(0x100000001B3) + w.hash[w.first[short[here]] + i] + np.uint64(i + 1))
    text, h = np.concatenate([w.text[at], short]), np.concatenate([h, whole])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def signatures(first: np.ndarray, h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of texts whose n-grams lie at ``first`` (one more than texts, none empty) in ``h``."""
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(first) - 1, bands), np.uint64)
    at = 0
    while at < len(first) - 1:
        end = max(at + 1, int(np.searchsorted(first, first[at] + _SLICE, side="right")) - 1)
        part, starts = h[first[at] : first[end]], first[at:end] - first[at]
        for band in range(bands):
            value = np.full(end - at, band, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                least = np.minimum.reduceat((part ^ seeds[0, k]) * seeds[1, k] >> np.uint64(32), starts)
                value = mixed(value * np.uint64(0x100000001B3) + least)
            out[at:end, band] = value
        at = end
    return out


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(row, doc_id, text_sha256, n_grams, set_a, set_b, bands) of each row, written once.

    set_a and set_b together stand for the set.
    """

    def work(batches: Batches) -> Batches:
        for batch in batches:
            text, h = shingles(words(batch.column(3)), n)
            size = np.bincount(text, minlength=batch.num_rows)
            used = np.flatnonzero(size)
            first = np.concatenate([[0], np.cumsum(size[used])])
            sums = np.zeros((2, batch.num_rows), np.uint64)
            found = np.zeros((batch.num_rows, bands), np.uint64)
            if len(used):
                sums[0, used] = np.add.reduceat(h, first[:-1])
                sums[1, used] = np.add.reduceat(mixed(h), first[:-1])
                found[used] = signatures(first, h, bands, rows)
            yield record(row=batch.column(0), doc_id=batch.column(1), text_sha256=batch.column(2), n_grams=size.astype(np.int64), set_a=sums[0].view(np.int64), set_b=sums[1].view(np.int64), bands=pa.array(found.view(np.int64).tolist(), pa.list_(pa.int64())))

    text = text_of()
    prepared = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("sha"), text.alias("text"))
    return kept(map_batches(prepared, work, "row bigint, doc_id bigint, text_sha256 string, n_grams bigint, set_a bigint, set_b bigint, bands array<bigint>"), "signed")


def components(members: DataFrame) -> DataFrame:
    """(node, label): the least node of all that hang together by groups; ``members`` is (node, group).

    Each round takes labels to groups and back, until none changes.  Tables are written in between, so that a large
    group meets its one label in a join that can be split.
    """
    labels = members.groupBy("node").agg(F.min("node").alias("label"))
    while True:
        labels = kept(labels, "labels")
        of_group = kept(members.join(labels, "node").groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")), "groups")
        if of_group.where("low < high").isEmpty():
            return labels
        labels = members.join(of_group, "group").groupBy("node").agg(F.min("low").alias("label"))


def verified(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of the texts of a block, or of two blocks: links to others (with copies, and as texts), and the least text linked on."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        sets = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        size = np.array([len(x) for x in sets])
        node, copies, block = (rows[c].to_numpy() for c in ("node", "copies", "block"))
        n = len(sets)
        grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), size)
        shared = count[column] > 1
        column, owner = (np.cumsum(count > 1) - 1)[column[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((n, n), np.float32)  # counts below 2**24 are exact
        tile = max(64, min(4096, (1 << 22) // n))
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, tile):
            a, b = np.searchsorted(column, [start, start + tile])
            held = np.zeros((n, tile), np.float32)
            held[owner[a:b], column[a:b] - start] = 1
            common += held @ held.T
        linked = common / np.maximum(size[:, None] + size[None, :] - common, 1).astype(np.float64) >= threshold
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= block[:, None] != block[None, :]
        label = np.arange(n)
        order = np.argsort(node)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        label = rank.copy()
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
            if (new == label).all():
                break
            label = new
        some = linked.any(axis=1)
        out = pd.DataFrame({"node": node, "links": linked @ copies, "texts": linked.sum(axis=1), "root": node[order][label]})[some]
        return out.assign(label=rows["label"].iloc[0], low=low, high=high)

    return work


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """doc_id, text_sha256, class_id, n_links, n_texts, copies, kept of every row of ``docs``.

    ``class_id`` is the least doc_id of the documents that hang together by links, ``n_links`` the number of documents
    that this one is linked to, copies included, ``n_texts`` the number of different sets among them, ``copies`` the
    documents of the same set.  One document of a class is ``kept``: that of the least id, of repeated rows the first;
    null ids come last.  Words are runs of characters other than space and 0x09 to 0x0D.  A text of fewer than ``n``
    words is one n-gram; null text, and text without words, is a class by itself.  No rows give no rows.
    """
    bands, rows = bands_for(threshold, recall)
    all_rows = signed(docs, n, bands, rows)
    some = all_rows.where("n_grams > 0")
    # copies are combined before anything else; what stays of them is the least row in the order of keeping
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    texts = kept(some.groupBy("set_a", "set_b").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("text_sha256", "bands"), place).alias("own")), "texts")
    texts = texts.select("set_a", "set_b", "place", F.col("place.row").alias("node"), F.col("place.doc_id").alias("doc_id"), "copies", "own.text_sha256", "own.bands")

    hashed = texts.select("node", F.explode("bands").alias("group"))
    shared = kept(hashed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group"), "shared")
    members = kept(hashed.join(shared, "group"), "members")
    groups = components(members)

    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    placed = groups.join(kept(sizes, "sizes"), "label").withColumn("blocks", F.expr(f"cast(ceil(size / {BLOCK}) as int)"))
    placed = kept(placed.join(texts, "node").select("node", "label", "copies", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "doc_id", "text_sha256"), "placed")
    sets = _with_sets(docs, placed, n)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meeting = sets.select("node", "label", "copies", "block", other.alias("other"), "grams")
    meeting = meeting.select("node", "label", "copies", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "grams")
    links = kept(meeting.groupBy("label", "low", "high").applyInPandas(verified(threshold), "node bigint, links bigint, texts bigint, root bigint, label bigint, low int, high int"), "links")

    linked = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = components(links.select("node", F.xxhash64("label", "low", "high", "root").alias("group"))).withColumnRenamed("label", "class")
    known = texts.select("set_a", "set_b", "node", "place", "copies").join(linked, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = known.groupBy("class").agg(F.min("place").alias("least"))
    known = kept(known.join(kept(least, "classes"), "class").select("set_a", "set_b", "copies", "links", "texts", "least"), "known")

    # a text's copies, however many, meet its one row here: the join can be split
    return all_rows.join(known, ["set_a", "set_b"], "left").select(
        "doc_id",
        "text_sha256",
        F.coalesce("least.doc_id", "doc_id").alias("class_id"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce(F.col("row") == F.col("least.row"), F.lit(True)).alias("kept"),
    )


def _with_sets(docs: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """``placed`` with the set of each text, for which the texts of candidates alone are read again."""
    wanted = keyed(placed, F.col("text_sha256")).drop("doc_id", "text_sha256")
    texts = keyed(docs.select("doc_id", "text")).join(wanted.hint("merge"), ROW_KEYS).dropDuplicates(["node"]).select("node", "label", "copies", "blocks", "block", "text")

    def work(batches: Batches) -> Batches:
        for batch in batches:
            text, h = shingles(words(batch.column(5)), n)
            first = np.searchsorted(text, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=[*batch.schema.names[:5], "grams"])

    return map_batches(texts, work, "node bigint, label bigint, copies bigint, blocks int, block int, grams binary")


def representatives(docs: DataFrame, **of) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    return only(docs, join(docs, **of).where("kept"))
