"""Approximate top-k by cosine with an inverted-file index: coarse centroids, lists, probes and exact re-scoring.

Centroids are fitted by k-means on a bounded sample of rows chosen by a hash of their id (``SAMPLE`` rows at most, a
documented parameter); every row of the corpus is then assigned to its nearest centroid, so the index covers all rows.
A query probes its ``probes`` nearest lists; within a list its candidates are scored exactly by a matrix product and
only the best ``k`` per query leave the task.  A list larger than ``LIST_ROWS`` is cut into parts by a hash of the id,
and each probing query meets every part, so no task holds more than a bounded part of any list, however skewed the
vectors are.  Nothing pairs queries with the corpus as rows; the exact way stays in ``retrieval.top_k``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import SCALE, _unit

#: Rows of the sample that centroids are fitted on, at most.
SAMPLE = 20_000
#: Rows of a list that one task scores at most, on average.
LIST_ROWS = 20_000


def fit(corpus: DataFrame, lists: int, iterations: int = 15, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """``lists`` unit centroids from k-means (cosine) over at most ``sample`` rows of ``id, embedding``."""
    chosen = corpus.where("embedding IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()
    if chosen.empty:
        return np.zeros((0, 0))
    points = _unit(chosen["embedding"])
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(iterations):
        nearest = np.argmax(points @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = norms[:, 0] > 0
        centroids[moved] = sums[moved] / norms[moved]
    return centroids


def top_k(queries: DataFrame, corpus: DataFrame, centroids: np.ndarray, k: int = 3, probes: int = 4, exclude_same: bool = False) -> DataFrame:
    """``qid, embedding`` and ``id, embedding`` to ``qid, rank, id, score`` over the probed lists.

    Null embeddings are neither asked nor found.  Scores are rounded to six digits, ties go to the smaller id.  A
    query finds fewer than ``k`` rows only if its probed lists hold fewer.
    """
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(centroids)  # lists x dimensions, fixed by the caller
    probes = min(probes, len(centroids))

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        order = np.argsort(-(_unit(vectors) @ shared.value.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(order.astype(np.int32)))

    rows = corpus.where("embedding IS NOT NULL").select("id", F.col("embedding").alias("v"))
    rows = rows.withColumn("list", nearest("v")[0])
    sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / LIST_ROWS).cast("int"))
    rows = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("n", "parts")
    asked = queries.where("embedding IS NOT NULL").select("qid", F.col("embedding").alias("v"))
    asked = asked.withColumn("list", F.explode(nearest("v")))
    asked = asked.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("n", "parts")
    qid, cid = queries.schema["qid"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        c = c.sort_values("id", kind="stable")
        ids, n = c["id"].to_numpy(), len(c)
        keys = np.rint(_unit(q["v"]) @ _unit(c["v"]).T * SCALE).astype(np.int64) * n + (n - 1 - np.arange(n))
        if exclude_same:
            keys[q["qid"].to_numpy()[:, None] == ids[None, :]] = np.iinfo(np.int64).min
        keep = min(k, n)
        top = np.argpartition(keys, n - keep, axis=1)[:, n - keep :]
        best = np.take_along_axis(keys, top, axis=1)
        found = best != np.iinfo(np.int64).min
        return pd.DataFrame({"qid": np.repeat(q["qid"].to_numpy(), found.sum(axis=1)), "id": ids[top[found]], "score": (best[found] // n) / SCALE})

    found = asked.groupBy("list", "part").cogroup(rows.groupBy("list", "part")).applyInPandas(score, f"qid {qid}, id {cid}, score double")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")
