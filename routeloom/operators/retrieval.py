"""Exact top-k search by cosine over vector columns.

Vectors are packed into bytes once.  Both sides are cut into blocks by a hash of their id, of a bounded number of packed
bytes and enough of them to keep all cores busy; a task scores one block of queries against one block of the corpus,
tile by tile, and gives back only the best ``k`` per query.  So no pair is ever a row, neither side is broadcast, copies
of one vector spread over all blocks, and a task holds two packed blocks and a few tiles, whatever the data.

A tile is multiplied in single precision first.  Its pairs that the rounding errors cannot keep out of the best ``k`` are
scored again in double precision; a query with many of these (the first tile, copies, equal scores) has its whole tile
done in double precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored
from .documents import document_label

#: Packed bytes of a block at most, on average.
BLOCK_BYTES = 24 << 20
#: Rows of a tile of queries, of the corpus, and of queries done in double precision at once.
QUERY_TILE, CORPUS_TILE, EXACT_TILE = 2048, 1024, 512
#: Pairs of a query in a tile beyond which the tile is done in double precision as a whole.
MANY = 32

SCALE = 1_000_000  # scores are compared at six digits, ties go to the smaller id

_NONE = np.iinfo(np.int64).min


def _normed(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    return _normed(np.stack(vectors.to_numpy()).astype(np.float64))


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.rint(scores * SCALE).astype(np.int64)


def _exact(q: np.ndarray, c: np.ndarray, own: Callable, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row, column and score of the ``k`` best of a tile for each of ``rows``."""
    n, out = len(c), []
    keep = min(k, n)
    for at in range(0, len(rows), EXACT_TILE):
        some = rows[at : at + EXACT_TILE]
        # one integer per pair: rounded score first, then the earlier column
        keys = _rounded(q[some] @ c.T) * n + (n - 1 - np.arange(n))
        keys[own(some[:, None], np.arange(n)[None, :])] = _NONE
        top = np.argpartition(keys, n - keep, axis=1)[:, n - keep :]
        best = np.take_along_axis(keys, top, axis=1)
        found = best != _NONE
        out.append((np.repeat(some, found.sum(axis=1)), top[found], best[found] // n))
    return tuple(np.concatenate(c) for c in zip(*out))


def _close(q: np.ndarray, c: np.ndarray, own: Callable, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs given with their scores, without those of a row and itself."""
    other = ~own(rows, columns)
    rows, columns = rows[other], columns[other]
    scores = [np.einsum("ij,ij->i", q[rows[at : at + 2048]], c[columns[at : at + 2048]]) for at in range(0, len(rows), 2048)]
    return rows, columns, _rounded(np.concatenate([np.zeros(0), *scores]))


def _best(queries: pd.DataFrame, corpus: pd.DataFrame, k: int, exclude_same: bool, of_query: Callable, of_corpus: Callable) -> pd.DataFrame:
    corpus = corpus.sort_values("id", kind="stable")
    ids, out = corpus["id"].to_numpy(), []
    for at in range(0, len(queries), QUERY_TILE):
        part = queries.iloc[at : at + QUERY_TILE]
        qids, q = part["qid"].to_numpy(), _normed(of_query(part["v"]))
        single = q.astype(np.float32)
        # single precision is off by less than this, unit vectors given; half a unit of the rounding comes on top
        slack = (q.shape[1] + 8) * 2.0**-22 + 0.5 / SCALE
        score, place = np.full((len(part), k), _NONE), np.full((len(part), k), -1)
        for start in range(0, len(ids), CORPUS_TILE):
            c = _normed(of_corpus(corpus["v"].iloc[start : start + CORPUS_TILE]))
            here = ids[start : start + CORPUS_TILE]

            def own(r, j):
                return qids[r] == here[j] if exclude_same else np.zeros(np.broadcast(r, j).shape, bool)

            # ids ascend over the tiles, so a pair must beat the last of the best, not equal it
            least = np.where(score[:, -1] == _NONE, -np.inf, score[:, -1] / SCALE - slack)
            near = single @ c.T.astype(np.float32) > least[:, None].astype(np.float32)
            many = near.sum(axis=1) > MANY
            many |= score[:, -1] == _NONE
            near[many] = False
            found = [_close(q, c, own, *np.nonzero(near))]
            if many.any():
                found.append(_exact(q, c, own, np.flatnonzero(many), k))
            rows, columns, scores = (np.concatenate(x) for x in zip(*found))
            if not len(rows):
                continue
            touched = np.unique(rows)
            rows = np.concatenate([np.repeat(touched, k), rows])
            scores = np.concatenate([score[touched].ravel(), scores])
            columns = np.concatenate([place[touched].ravel(), columns + start])
            order = np.lexsort((columns, -scores, rows))  # -_NONE is _NONE, which would come first
            order = order[scores[order] != _NONE]
            rows, scores, columns = rows[order], scores[order], columns[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = nth < k
            score[rows[kept], nth[kept]], place[rows[kept], nth[kept]] = scores[kept], columns[kept]
        full = score != _NONE
        out.append(pd.DataFrame({"qid": np.repeat(qids, full.sum(axis=1)), "id": ids[place[full]], "score": score[full] / SCALE}))
    return pd.concat(out)


def _packed(side: DataFrame) -> tuple[DataFrame, Callable]:
    """Vectors of ``v`` as bytes, and what turns a column of these into a matrix again."""
    element = side.schema["v"].dataType
    single = isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType)
    dtype = "<f4" if single else "<f8"

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, dtype).tobytes())

    def unpack(cells: pd.Series) -> np.ndarray:
        if cells.str.len().nunique() > 1:
            raise ValueError("vectors of one side differ in length")
        return np.frombuffer(b"".join(cells), dtype).reshape(len(cells), -1).astype(np.float64)

    return side.withColumn("v", pack("v")), unpack


def cuts(
    of_queries: tuple[int, int],
    of_corpus: tuple[int, int],
    block_bytes: int,
    cores: int,
    query_block: int = 400_000,
    corpus_block: int = 400_000,
) -> tuple[int, int]:
    """Numbers of blocks of both sides, whose rows and bytes are given."""
    (rows_q, bytes_q), (rows_c, bytes_c) = of_queries, of_corpus
    nq = max(1, -(-rows_q // query_block), -(-bytes_q // block_bytes))
    nc = max(1, -(-rows_c // corpus_block), -(-bytes_c // block_bytes))
    # cut further until all cores are busy, where that copies the fewest bytes
    tasks = 2 * cores
    ways = [(max(nq, cut), max(nc, -(-tasks // max(nq, cut)))) for cut in range(1, tasks + 1)]
    nq, nc = min(ways, key=lambda way: bytes_q * way[1] + bytes_c * way[0])
    return max(1, min(nq, rows_q)), max(1, min(nc, rows_c))


def paired(queries: DataFrame, corpus: DataFrame, nq: int, nc: int, apart: bool = False) -> tuple[GroupedData, GroupedData]:
    """Both sides by pair of blocks, to be cogrouped; a row is in the block of the hash of its id.

    ``apart`` gives each pair of blocks a task of its own, as far as labels are found that hash to different ones.
    """
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", block("qid", nq)).withColumn("_c", numbered(nc))
    right = corpus.withColumn("_c", block("id", nc)).withColumn("_q", numbered(nq))
    if not apart:
        return left.groupBy("_q", "_c"), right.groupBy("_q", "_c")
    n = nq * nc
    # numbers by the task that Spark sends them to
    tried = queries.sparkSession.range(20 * n + 100).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("task"))
    labels = sorted(r.i for r in tried.groupBy("task").agg(F.min("i").alias("i")).collect())
    labels += [max(labels) + 1 + i for i in range(n - len(labels))]
    pair = F.array(*map(F.lit, labels))[F.col("_q") * nc + F.col("_c")].alias("_pair")
    both = [side.select(pair, *(c for c in side.columns if c not in ("_q", "_c"))).repartition(n, "_pair") for side in (left, right)]
    return both[0].groupBy("_pair"), both[1].groupBy("_pair")


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    exclude_same: bool = False,
    query_block: int = 400_000,
    corpus_block: int = 400_000,
    unpack: Callable[[pd.Series], np.ndarray] | None = None,
) -> DataFrame:
    """``qid, embedding`` and ``id, embedding`` to the ``k`` most similar rows: ``qid, rank, id, score``.

    Embeddings are arrays of numbers, or bytes of which ``unpack`` makes a matrix, a row per cell.
    """
    spark = queries.sparkSession
    queries = queries.where("embedding IS NOT NULL").select("qid", F.col("embedding").alias("v"))
    corpus = corpus.where("embedding IS NOT NULL").select("id", F.col("embedding").alias("v"))
    if unpack:
        of_query = of_corpus = unpack
    else:
        (queries, of_query), (corpus, of_corpus) = _packed(queries), _packed(corpus)
    queries, corpus = stored(queries), stored(corpus)

    def measured(side: DataFrame) -> tuple[int, int]:
        return tuple(side.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first())

    size_q, size_c = measured(queries), measured(corpus)
    nq, nc = cuts(size_q, size_c, BLOCK_BYTES, spark.sparkContext.defaultParallelism, query_block, corpus_block)
    left, right = paired(queries, corpus, nq, nc)
    qid, cid = queries.schema["qid"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()

    def score(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        return _best(q, c, k, exclude_same, of_query, of_corpus)

    found = left.cogroup(right).applyInPandas(score, f"qid {qid}, id {cid}, score double")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def shaped_documents(found: DataFrame, chunks: DataFrame, max_docs: int | None = None) -> DataFrame:
    """Results with their content, label and file name: ``qid, rank, content, source, filename``."""
    if max_docs is not None:
        found = found.where(F.col("rank") <= max_docs)
    texts = chunks.select("id", F.col("text").alias("content"), F.col("source").alias("filename"))
    return found.join(texts, "id").select("qid", "rank", "content", document_label("filename").alias("source"), "filename", "score")
