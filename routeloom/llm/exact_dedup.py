"""Exact deduplication with a cuckoo-filter index of live digests.

The index is cut into shards by digest.  A shard has a cuckoo filter (two candidate buckets of four 16-bit fingerprints
a digest) and the live keys themselves, kept by bucket.  A digest the filter does not know is new without further
reading; a hit is verified against the keys of its bucket.  Deleting a key takes its fingerprint out.  When an insertion
finds no room, the filter is made anew with twice the buckets from the stored keys.

Copies are combined before they are shuffled, in a few salts per digest, so a hot text reaches its shard as a few rows;
shards hold a bounded number of keys, so their number grows with the corpus.  SHA-256 and the length in bytes together
stand for the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, only, text_of

#: Keys of a shard on average.
SHARD = 50_000
SALTS = 16

_SLOTS = 4
_KICKS = 200

KEYS = "shard int, digest string, n_bytes bigint, keep_id bigint, keep_row bigint, copies bigint"
FILTERS = "shard int, buckets int, fingerprints binary"


class Shard:
    """A cuckoo filter and the live keys that it speaks for, by bucket: digest -> [n_bytes, keep_id, keep_row, copies]."""

    def __init__(self, buckets: int = 16, fingerprints: bytes | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if fingerprints is None else np.frombuffer(fingerprints, np.uint16).reshape(buckets, _SLOTS).copy()
        self.content: dict[int, dict[str, list]] = {}
        self.verified = 0

    def _places(self, digest: str) -> tuple[int, int, int]:
        """The fingerprint, from the end of the digest as its start chose the shard, and both buckets."""
        fingerprint = int(digest[-4:], 16) or 1
        first = int(digest[-20:-4], 16) & (self.buckets - 1)
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ fingerprint * 0x5BD1E995) & (self.buckets - 1)

    def find(self, digest: str) -> list | None:
        fingerprint, first, second = self._places(digest)
        if fingerprint not in self.table[first] and fingerprint not in self.table[second]:
            return None
        self.verified += 1
        return self.content.get(first, {}).get(digest)

    def insert(self, digest: str, entry: list) -> None:
        """Of a digest that is not there."""
        _, first, _ = self._places(digest)
        self.content.setdefault(first, {})[digest] = entry
        if not self._place(digest):
            self.resize()

    def _place(self, digest: str) -> bool:
        fingerprint, first, second = self._places(digest)
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fingerprint
                return True
        bucket = second
        for kick in range(_KICKS):
            slot = (fingerprint + kick) % _SLOTS
            fingerprint, self.table[bucket, slot] = int(self.table[bucket, slot]), fingerprint
            bucket = self._other(bucket, fingerprint)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fingerprint
                return True
        return False  # the last fingerprint moved out has no place: the filter has to be made anew

    def resize(self) -> None:
        """Doubles the buckets until all stored keys have a place."""
        keys = [(d, e) for bucket in self.content.values() for d, e in bucket.items()]
        fits = False
        while not fits:
            self.buckets *= 2
            self.table = np.zeros((self.buckets, _SLOTS), np.uint16)
            fits = all(self._place(d) for d, _ in keys)
        self.content = {}
        for d, e in keys:
            self.content.setdefault(self._places(d)[1], {})[d] = e

    def delete(self, digest: str) -> bool:
        """Whether it was live."""
        if self.find(digest) is None:
            return False
        fingerprint, first, second = self._places(digest)
        bucket = self.content[first]
        del bucket[digest]
        if not bucket:
            del self.content[first]
        place = first if fingerprint in self.table[first] else second
        self.table[place, int(np.flatnonzero(self.table[place] == fingerprint)[0])] = 0
        return True

    def rows(self, shard: int) -> pd.DataFrame:
        rows = [(shard, d, *e) for bucket in self.content.values() for d, e in bucket.items()]
        return pd.DataFrame(rows, columns=["shard", "digest", "n_bytes", "keep_id", "keep_row", "copies"]).astype({"keep_id": "Int64"})


def _order(keep_id, keep_row) -> tuple:
    return (-1, keep_row, 0) if pd.isna(keep_id) else (0, keep_id, keep_row)


def arrive(shard: Shard, digest: str, n_bytes: int, keep_id, keep_row: int, copies: int) -> None:
    """Copies of a text come in; the live one is that of the largest id, then the largest row; null ids are the least."""
    known = shard.find(digest)
    if known is not None and known[0] == n_bytes:
        copies += known[3]
        if _order(known[1], known[2]) > _order(keep_id, keep_row):
            keep_id, keep_row = known[1], known[2]
        shard.delete(digest)
    shard.insert(digest, [n_bytes, keep_id, keep_row, copies])


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_sha256, n_bytes) of each row, written once so that row numbers stay."""
    text = text_of()
    return kept(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("bigint").alias("n_bytes")), "digests")


def shard_of(digest: str, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def update(index: DataFrame | None, arriving: DataFrame, leaving: DataFrame | None, shards: int) -> DataFrame:
    """The keys of the index after the rows of ``leaving`` (text_sha256) are deleted and then ``arriving`` inserted.

    ``arriving`` is (row, doc_id, text_sha256, n_bytes); ``index`` holds KEYS of an earlier call with as many shards.
    Each shard's filter is rebuilt from its stored keys.  Text in ``leaving`` that is not live is passed over.
    """
    n = F.lit(SALTS)
    salted = arriving.groupBy("text_sha256", "n_bytes", F.pmod("row", n).alias("salt")).agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("copies"))
    changes = salted.select(shard_of("text_sha256", shards).alias("shard"), F.lit(1).alias("change"), F.col("text_sha256").alias("digest"), "n_bytes", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "copies")
    none = F.lit(None).cast("bigint")
    if leaving is not None:
        gone = leaving.select("text_sha256").distinct()
        changes = changes.union(gone.select(shard_of("text_sha256", shards), F.lit(0), "text_sha256", none, none, none, none))
    if index is not None:
        changes = changes.union(index.select("shard", F.lit(-1), "digest", "n_bytes", "keep_id", "keep_row", "copies"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(buckets=1 << max(4, int(rows["digest"].nunique() / (_SLOTS * 0.9)).bit_length()))
        rows = rows.sort_values(["change", "keep_id", "keep_row", "digest"])
        for change, digest, *entry in rows[["change", "digest", "n_bytes", "keep_id", "keep_row", "copies"]].itertuples(index=False, name=None):
            if change == 0:
                shard.delete(digest)
            else:
                arrive(shard, digest, *(None if pd.isna(x) else int(x) for x in entry))
        return shard.rows(int(rows["shard"].iloc[0]))

    return changes.groupBy("shard").applyInPandas(work, KEYS)


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text); null text is empty.

    Texts are equal when identical.  Of equal texts the row with the largest doc_id stays; null ids are the least; of
    rows that repeat an id with the same text one stays.  No rows give no rows; other columns are ignored.
    """
    rows = digests(docs)
    shards = max(1, -(-rows.count() // SHARD))
    live = update(None, rows, None, shards).select(F.col("digest").alias("text_sha256"), "keep_id", "keep_row", F.col("copies").alias("group_size"))
    # a text's many rows meet its one live key here: adaptive execution splits such a partition
    return rows.join(live, "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return only(docs, deduplicate(docs).where("kept"))
