"""Exact top-k over hashed TF-IDF terms with an impact-ordered inverted index and block maxima.

Every chunk is a sparse unit vector, rows ``(id, slot, w)``; nothing is ever dense.  Postings of a slot are ordered by
impact: ``level`` is the weight on a quarter-octave scale (level 0 holds the largest weights), and a level with many
postings is cut into sub-blocks by a hash of the id, so that no block and no join key grows with the corpus.  Each
block keeps its largest weight.

A query is answered in two passes, both joins and aggregations:

1. The postings of the top level of each query slot give candidates whose exact scores bound the query's k-th
   score from below: ``theta``.
2. Slots in ascending order of their reach ``q_s * max_s`` are skipped while the reaches add up to at most
   ``(theta - eps) / 2``; of the other ``r`` slots a block is read only if ``q_s * max`` reaches the rest of the
   bound over ``r``.  A chunk outside all read blocks scores at most ``sum_s q_s * max_unread_s < theta - eps``,
   so it cannot reach the top k even after scores are rounded to six digits; the chunks of the read blocks are
   scored exactly.

Scores are rounded to six digits and ties go to the smaller id, as over all pairs; chunks that share no slot with a
query score 0, so the ``k`` smallest ids of the corpus are always candidates too.  A query with fewer than ``k``
positive candidates in pass 1 reads all of its blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .documents import term_slots

#: Postings of a block at most, on average.
BLOCK = 256
#: Levels per octave of weight.
LEVELS = 4
#: Rounding of scores; blocks are kept with this margin.
EPS = 1e-6


def sparse_vectors(rows: DataFrame, key: str, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``key, slot, w``: hashed TF-IDF of unit length, only slots of positive weight; rows without such slots give none."""
    spark = rows.sparkSession
    idf = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "slot int, idf double")  # one row a slot
    tf = rows.select(key, F.explode(term_slots(text, len(weights))).alias("slot")).groupBy(key, "slot").agg(F.count(F.lit(1)).alias("n"))
    raw = tf.join(F.broadcast(idf), "slot").select(key, "slot", (F.col("n") * F.col("idf")).alias("v")).where("v > 0")
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, key).select(key, "slot", (F.col("v") / F.col("norm")).alias("w"))


def index(vectors: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Postings ``slot, level, sub, id, w`` and blocks ``slot, level, sub, high, n`` of ``id, slot, w`` rows."""
    level = F.floor(-F.log2("w") * LEVELS).cast("int")
    leveled = vectors.withColumn("level", level)
    sizes = leveled.groupBy("slot", "level").agg(F.count(F.lit(1)).alias("size"))
    postings = leveled.join(sizes, ["slot", "level"]).withColumn(
        "sub", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block)).cast("int")
    ).select("slot", "level", "sub", "id", "w")
    blocks = postings.groupBy("slot", "level", "sub").agg(F.max("w").alias("high"), F.count(F.lit(1)).alias("n"))
    return postings, blocks


def _scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact scores of ``qid, id`` pairs: the sum over shared slots; pairs without any score 0."""
    terms = pairs.join(queries, "qid", "left").join(vectors, ["id", "slot"], "left")
    return terms.groupBy("qid", "id").agg(F.round(F.coalesce(F.sum(F.col("q") * F.col("w")), F.lit(0.0)), 6).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(asked_ids: DataFrame, queries: DataFrame, vectors: DataFrame, ids: DataFrame, k: int = 3, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``qid, rank, id, score`` of the k best chunks for each query, and ``qid, blocks, read`` of each query.

    ``asked_ids`` holds every ``qid``, ``queries`` their ``qid, slot, q`` rows, ``vectors`` ``id, slot, w`` rows, ``ids``
    every chunk id (chunks without any weighted slot included).  A query without slots scores 0 everywhere and gets
    the k smallest ids.  Ids and qids are distinct; no chunks give no rows.
    """
    postings, blocks = index(vectors, block)
    queries = queries.select("qid", "slot", F.col("q"))
    width = asked_ids.select("qid").join(queries.groupBy("qid").agg(F.count(F.lit(1)).alias("m")), "qid", "left").fillna(0, ["m"])
    # the k smallest ids: chunks of score 0 come in id order; k values, not more
    first = [r.id for r in ids.orderBy("id").limit(k).collect()]
    # pass 1: top level of every slot
    top = blocks.groupBy("slot").agg(F.min("level").alias("level"))
    seen = queries.join(top, "slot").join(postings, ["slot", "level"]).select("qid", "id").distinct()
    lower = _best(_scored(seen, queries, vectors), k)
    theta = lower.groupBy("qid").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("t"))
    theta = width.join(theta, "qid", "left").select("qid", "m", F.when(F.col("c") >= k, F.col("t")).otherwise(F.lit(0.0)).alias("theta"))
    # pass 2: slots whose whole reach stays under half the bound are not read at all; the rest share what is left
    tops = blocks.groupBy("slot").agg(F.max("high").alias("top"))
    reach = queries.join(theta, "qid").join(tops, "slot").withColumn("c", F.col("q") * F.col("top"))
    upto = Window.partitionBy("qid").orderBy("c", "slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = reach.withColumn("skip", (F.col("theta") > 0) & (F.sum("c").over(upto) <= (F.col("theta") - EPS) / 2))
    shares = reach.groupBy("qid").agg(
        F.sum(F.when(F.col("skip"), F.col("c")).otherwise(F.lit(0.0))).alias("used"),
        F.sum(F.when(F.col("skip"), F.lit(0)).otherwise(F.lit(1))).alias("r"),
    )
    asked = reach.join(shares, "qid").join(blocks, "slot")
    limit = (F.col("theta") - EPS - F.col("used")) / F.greatest(F.col("r"), F.lit(1))
    needed = (F.col("theta") <= 0) | (~F.col("skip") & (F.col("q") * F.col("high") >= limit))
    counts = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("blocks"), F.sum(needed.cast("int")).cast("bigint").alias("read"), F.max("theta").alias("theta"))
    read = asked.where(needed).select("qid", "slot", "level", "sub")
    found = read.join(postings, ["slot", "level", "sub"]).select("qid", "id")
    zero = width.select("qid", F.explode(F.array(*[F.lit(i) for i in first]).cast(f"array<{ids.schema['id'].dataType.simpleString()}>")).alias("id"))
    candidates = found.unionByName(zero).distinct()
    return _best(_scored(candidates, queries, vectors), k).select("qid", "rank", "id", "score"), counts
