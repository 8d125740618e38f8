"""Quality rules: counts of words, symbols and repetition, and a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed into ``buckets``.  Two multinomials over the buckets are counted: one over all
documents, one over the trusted ones; a bucket's ratio is drawn to the overall one by ``prior`` pseudo-counts, so rare
words say little.  A document's score is the sum of log(trusted share / corpus share) over its words and pairs, divided
by their number.  A document is kept if its score reaches a threshold: the one that best tells trusted documents from
bad ones (largest difference of the two shares kept; the middle of the range of equally good ones), found from a
histogram over all labelled documents of one fold in five that pass the base rules; the trusted counts leave it out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, kept, map_batches, record, text_of
from .words import Words, lines, repeated, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True  # fixed values

_BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """Per text of a batch: words, their characters, symbols, lines that repeat, words in three-word runs that repeat."""
    n_words = np.diff(w.first)
    head = (w.data & 0xC0) != 0x80  # one byte of each character
    spaces = w.count_bytes((w.data == 0x20) | ((w.data >= 0x09) & (w.data <= 0x0D)))
    line_text, line_hash = lines(w)
    dup = repeated(line_text, line_hash)[1]
    at, h = w.grams(3)
    more = at[repeated(w.text[at], h)[0]]
    covered = np.zeros(len(w.start), bool)
    for i in range(3):
        covered[more + i] = True
    return {"n_words": n_words, "word_chars": w.count_bytes(head) - spaces, "n_symbols": w.count_bytes(_SYMBOL[w.data]), "n_dup_lines": w.per_text(line_text[dup]), "n_repeat_words": w.per_text(w.text[covered])}


def _hashed(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and buckets of all words and word pairs."""
    at, pairs = w.grams(2)
    hashes = np.concatenate([w.hash, pairs])
    return np.concatenate([w.text, w.text[at]]), (hashes & np.uint64(buckets - 1)).astype(np.int64)


def judged(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted, held_out) of documents whose labels all say good and none toxic, or one of whose says bad."""
    of = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    of = of.where((F.col("quality") == 0) | (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return of.select("doc_id", (F.col("quality") == 1).alias("trusted"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held_out"))


def some_of(labels: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of doc_id: a bound on what is fitted to, and on what is broadcast for it."""
    share = min(1.0, most / max(1, labels.count()))
    return labels.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < share * (1 << 30))


def bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the texts of ``docs``."""

    def work(batches: Batches) -> Batches:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(_hashed(words(batch.column(0)), buckets)[1], minlength=buckets)
        used = np.flatnonzero(sums)
        yield record(bucket=used, n=sums[used])

    found = map_batches(docs.select(text_of().alias("text")), work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ``buckets`` rows
    out = np.zeros(buckets)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def log_ratios(docs: DataFrame, labelled: DataFrame, buckets: int, prior: float, fit_rows: int | None = None) -> np.ndarray:
    """log(trusted share / corpus share) of each bucket.  All zero if nothing is trusted.

    All trusted documents that are not held out count, or about ``fit_rows`` of them if that is given.
    """
    trusted = labelled.where("trusted AND NOT held_out").select("doc_id")
    if fit_rows is not None:
        trusted = some_of(trusted, fit_rows)
    # sorted and merged whatever the sizes: neither side has a bound
    good = bucket_counts(docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left_semi"), buckets)
    if not good.any():
        return np.zeros(buckets, np.float32)
    corpus = bucket_counts(docs, buckets)
    share = good.sum() / corpus.sum()
    return np.log((good + prior * share) / (corpus + prior) / share).astype(np.float32)


def measured(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, the base counts and the score of each row; a text without words scores 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def work(batches: Batches) -> Batches:
        for batch in batches:
            w = words(batch.column(1))
            at, bucket = _hashed(w, len(shared.value))
            n = w.per_text(at)
            score = w.per_text(at, shared.value[bucket].astype(np.float64)) / np.maximum(n, 1)
            yield record(doc_id=batch.column(0), **{k: v.astype(np.int64) for k, v in base_counts(w).items()}, score=score)

    return map_batches(docs.select("doc_id", text_of().alias("text")), work, f"doc_id bigint, {_BASE}, score double")


def threshold(scores: DataFrame, labelled: DataFrame) -> float:
    """See above; bins of 0.002.  Minus infinity unless there are trusted and bad documents in the fold."""
    bins = scores.join(labelled.where("held_out"), "doc_id").groupBy(F.floor(F.col("score") * 500).alias("bin")).agg(F.sum(F.col("trusted").cast("int")).alias("good"), F.sum((~F.col("trusted")).cast("int")).alias("bad"))
    found = sorted(tuple(r) for r in bins.collect())  # as many rows as bins
    good, bad = sum(r[1] for r in found), sum(r[2] for r in found)
    if not good or not bad:
        return float("-inf")
    best, low, high, lost, caught = 0.0, float("-inf"), float("-inf"), 0, 0
    for i, (b, g, x) in enumerate(found[:-1]):
        lost, caught = lost + g, caught + x
        if caught / bad - lost / good > best:
            best, low, high = caught / bad - lost / good, (b + 1) / 500, found[i + 1][0] / 500
    return (low + high) / 2


def rules(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 18, prior: float = 10.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept of every row.

    ``labels`` is (doc_id, quality, toxic).  Null text has no words and fails the base rules.  Rows are judged each by
    itself, repeated ones and those without an id too.  Without trusted or without bad documents only the base
    rules decide.  No rows give no rows; other columns are ignored.
    """
    labelled = judged(labels)
    found = kept(measured(docs, log_ratios(docs, labelled, buckets, prior)), "rules")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    least = threshold(found.where("NOT base_failed"), labelled)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
