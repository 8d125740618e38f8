"""Exact top-k search by cosine over hashed TF-IDF vectors, kept as the slots of their terms.

Multiplying blocks of such vectors as numbers is dear, so a task first bounds all its scores from above by whole numbers:
what a term of a query adds to the score of a text is taken in units and rounded up, in a byte, and three texts share a
single-precision number, 24 bits of which are exact.  One product of matrices so bounds three scores a multiplication.  The
unit is so chosen that no sum of a byte can run over.  Only pairs whose bound reaches the query's k-th score so far are
scored in double precision; a query with many such pairs in a tile has the tile done in double precision as a whole.

Each query starts with its k-th score over a small part of the corpus, worked out first in the same way; that only spares
pairs, every pair of the corpus is bounded or scored.  Ties and results are those of ``retrieval.top_k``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval

#: Packed bytes of a block at most, on average.
BLOCK_BYTES = 16 << 20
#: Texts in a number, bits and places of a tile of the corpus; queries of a tile.
LANES, BITS, WIDE, QUERY_TILE = 3, 8, 1024, 2048
#: Rows of a block that are scored with every query in double precision.
HEAD = 128
#: Pairs of a query in a tile beyond which the tile is done as a whole.
MANY = 512
#: Rows of the corpus that give each query its first bound.
PILOT = 32_768
#: Largest ratio of norms of queries that share a unit.
RATIO = 1.4
#: Terms of a query at most for three texts in a number, for one, and for any bounds.
FEW, MOST = 100, 1 << 20

_NONE = retrieval._NONE


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of slices, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Terms:
    """Packed cells as sparse rows: of row ``r``, ``slot`` and ``unit`` from ``start[r]`` to ``start[r + 1]``."""

    def __init__(self, cells: pd.Series, weights: np.ndarray) -> None:
        n, dims = len(cells), len(weights)
        #: terms of each row, repeats included
        self.size = np.fromiter((len(c) // 2 for c in cells), np.int64, n)
        keys = np.repeat(np.arange(n) * dims, self.size) + np.frombuffer(b"".join(cells), "<u2")
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.times = np.diff(first, append=len(keys)).astype(np.int32)
        rows, self.slot = np.divmod(keys[first], dims)
        self.slot = self.slot.astype(np.int32)
        self.start = np.searchsorted(rows, np.arange(n + 1))
        value = self.times * weights[self.slot]
        self.norm = np.sqrt(np.bincount(rows, value * value, minlength=n))
        self.unit = np.divide(value, self.norm[rows], out=np.zeros_like(value), where=value > 0)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the elements of ``rows``, and which of these each is of."""
        lengths = self.start[rows + 1] - self.start[rows]
        return _spread(self.start[rows], lengths), np.repeat(np.arange(len(rows)), lengths)

    def matrix(self, rows: np.ndarray, dims: int) -> np.ndarray:
        """Vectors of unit length."""
        at, row = self.of(rows)
        out = np.zeros((len(rows), dims))
        out[row, self.slot[at]] = self.unit[at]
        return out

    def counts(self, rows: np.ndarray, dims: int) -> np.ndarray:
        """How often the terms of each slot occur."""
        at, row = self.of(rows)
        out = np.zeros((len(rows), dims), np.float32)
        out[row, self.slot[at]] = self.times[at]
        return out


def _products(q: _Terms, rows: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row, column and score of the ``k`` best of a tile for each of ``rows``, as products of matrices."""
    none = lambda r, j: np.zeros(np.broadcast(r, j).shape, bool)
    parts = [rows[at : at + retrieval.EXACT_TILE] for at in range(0, len(rows), retrieval.EXACT_TILE)]
    found = [(part, retrieval._exact(q.matrix(part, c.shape[1]), c, none, np.arange(len(part)), k)) for part in parts]
    return tuple(np.concatenate(x) for x in zip(*((part[r], j, s) for part, (r, j, s) in found)))


def _pairs(q: _Terms, rows: np.ndarray, columns: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of the pairs given."""
    out = [np.zeros(0)]
    for a in range(0, len(rows), 4096):
        at, pair = q.of(rows[a : a + 4096])
        cell = (columns[a : a + 4096] * c.shape[1])[pair] + q.slot[at]
        out.append(np.bincount(pair, q.unit[at] * c.ravel().take(cell), minlength=len(rows[a : a + 4096])))
    return retrieval._rounded(np.concatenate(out))


def _groups(q: _Terms) -> list[tuple[int, float, np.ndarray]]:
    """Queries that share a table: texts in a number, units, and the queries."""
    out = []
    for lanes, lower, upper in ((LANES, 0, FEW), (1, FEW, MOST)):
        rows = np.flatnonzero((q.norm > 0) & (q.size > lower) & (q.size <= upper))
        rows = rows[np.argsort(q.norm[rows], kind="stable")]
        while len(rows):
            n = np.searchsorted(q.norm[rows], q.norm[rows[0]] * RATIO, "right")
            # a sum is at most the norm of the query in units, and one more for each term, as units are rounded up
            units = ((1 << LANES * BITS // lanes) - 2 - q.size[rows[:n]].max()) / q.norm[rows[n - 1]]
            out += [(lanes, units, rows[at : min(at + QUERY_TILE, n)]) for at in range(0, n, QUERY_TILE)]
            rows = rows[n:]
    return out


def _near(bounds: np.ndarray, least: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the bounds that reach the least of their row."""
    if lanes == 1:
        return np.nonzero(bounds >= least[:, None].astype(np.float32))
    reached = bounds.astype("<u4").view(np.uint8) >= np.minimum(least, 255).astype(np.uint8)[:, None]  # the fourth byte is 0
    eight = reached.view(np.uint64).ravel().nonzero()[0]
    which, byte = reached.reshape(-1, 8)[eight].nonzero()
    row, at = np.divmod(eight[which] * 8 + byte, reached.shape[1])
    return row, at % 4 * WIDE + at // 4


def best(queries: pd.DataFrame, corpus: pd.DataFrame, weights: np.ndarray, k: int) -> pd.DataFrame:
    """``qid, id, score`` of the ``k`` best of a block of the corpus for each query, without those under its ``least``."""
    corpus = corpus.sort_values("id", kind="stable")
    ids, qids, dims = corpus["id"].to_numpy(), queries["qid"].to_numpy(), len(weights)
    q, c = _Terms(queries["v"], weights), _Terms(corpus["v"], weights)
    # pairs under this score are out
    floor = np.rint(queries["least"].fillna(0).to_numpy(np.float64) * retrieval.SCALE)
    score, place = np.full((len(qids), k), _NONE), np.full((len(qids), k), -1)

    def merge(rows: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, k), rows])
        scores = np.concatenate([score[touched].ravel(), scores])
        places = np.concatenate([place[touched].ravel(), places])
        order = np.flatnonzero(scores != _NONE)
        order = order[np.lexsort((places[order], -scores[order], rows[order]))]
        rows, scores, places = rows[order], scores[order], places[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = nth < k
        score[rows[kept], nth[kept]], place[rows[kept], nth[kept]] = scores[kept], places[kept]

    # the first ids are the best of those that score 0, so none of these can come later
    head = min(max(HEAD, k), len(ids))
    merge(*_products(q, np.arange(len(qids)), c.matrix(np.arange(head), dims), k))
    groups = _groups(q)
    huge = np.flatnonzero(q.size > MOST)
    exact = np.zeros((LANES * WIDE, dims))
    for at in range(head, len(ids), LANES * WIDE):
        tile = np.arange(at, min(at + LANES * WIDE, len(ids)))
        places, column = c.of(tile)
        slot, unit = c.slot[places], c.unit[places]
        adds = (unit * weights[slot]).astype(np.float32)
        exact[column, slot] = unit
        found, whole, shared = [], [huge], None
        for lanes, units, rows in groups:
            if shared != (lanes, units):
                table = _table(slot, column, np.ceil(adds * np.float32(units * (1 + 1e-6))), dims, lanes)
                shared = (lanes, units)
            # ids ascend over the tiles, so a pair must beat the last of the best, not equal it
            need = np.maximum(floor[rows] - 0.5, score[rows, -1] + 0.5) / retrieval.SCALE
            # less by more than rounding errors are
            least = np.maximum(np.ceil((need * (1 - 1e-6) - 1e-9) * q.norm[rows] * units - 1e-3), 1)
            r, j = _near(q.counts(rows, dims) @ table, least, lanes)
            many = np.bincount(r, minlength=len(rows)) > MANY
            whole.append(rows[many])
            found.append((rows[r[~many[r]]], j[~many[r]]))
        whole = np.concatenate(whole)
        if len(whole):
            r, j, s = _products(q, whole, exact[: len(tile)], k)
            merge(r, tile[j], s)
        for r, j in found:
            s = _pairs(q, r, j, exact)
            good = s >= np.maximum(floor[r], score[r, -1] + 1)
            if good.any():
                merge(r[good], tile[j[good]], s[good])
        exact[column, slot] = 0
    full = score != _NONE
    return pd.DataFrame({"qid": np.repeat(qids, full.sum(axis=1)), "id": ids[place[full]], "score": score[full] / retrieval.SCALE})


def _table(slot: np.ndarray, column: np.ndarray, units: np.ndarray, dims: int, lanes: int) -> np.ndarray:
    """Whole units of every slot and text of a tile; of ``lanes`` texts in one number, if more than one."""
    most = np.float32((1 << LANES * BITS // lanes) - 1)  # only of terms that no query of the group has
    units = np.minimum(units, most)
    table = np.zeros((LANES * WIDE // lanes, dims), np.float32)
    if lanes == 1:
        table[column, slot] = units
        return table.T
    ends = np.searchsorted(column, np.arange(lanes + 1) * WIDE)  # columns ascend
    for i in range(lanes):
        own = slice(ends[i], ends[i + 1])
        table.ravel()[(column[own] - i * WIDE) * dims + slot[own]] += units[own] * np.float32(1 << BITS * i)
    return table.T


def top_k(queries: DataFrame, corpus: DataFrame, weights: np.ndarray, k: int = 3, pilot: int = PILOT) -> DataFrame:
    """``qid, embedding`` and ``id, embedding``, packed, to the ``k`` most similar rows: ``qid, rank, id, score``.

    Both sides are read several times, so they should be stored.
    """
    queries = queries.select("qid", F.col("embedding").alias("v"), F.lit(None).cast("double").alias("least"))
    corpus = corpus.select("id", F.col("embedding").alias("v"))
    size = lambda side: side.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()
    of_queries, of_corpus = size(queries), size(corpus)
    parts = of_corpus[0] // pilot
    if parts >= 4:
        some = corpus.where(F.pmod(F.hash("id"), F.lit(parts)) == 0)
        first = _scored(queries, some, of_queries, [of_corpus[0] // parts, of_corpus[1] // parts], weights, k)
        least = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        queries = queries.drop("least").join(least, "qid", "left")
    found = _scored(queries, corpus, of_queries, of_corpus, weights, k)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def _scored(queries: DataFrame, corpus: DataFrame, of_queries, of_corpus, weights: np.ndarray, k: int) -> DataFrame:
    """The best of every block of the corpus: ``qid, id, score``."""
    # small tasks even out
    nq, nc = retrieval.cuts(of_queries, of_corpus, BLOCK_BYTES, 2 * queries.sparkSession.sparkContext.defaultParallelism)
    left, right = retrieval.paired(queries, corpus, nq, nc, apart=True)
    qid, cid = queries.schema["qid"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()

    def score(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        return best(q, c, weights, k)

    return left.cogroup(right).applyInPandas(score, f"qid {qid}, id {cid}, score double")
