"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Each round rewires every node's edges towards the least node of its neighbourhood; after O(log n) rounds every
component is a star around its least node.  Every round is two aggregations and two joins on the edge table and is
written to the shared folder, so the lineage stays one round long and a lost executor redoes one round only.  A node
with many neighbours is one group of an aggregation (partial sums before the shuffle) and one key of a join that
adaptive execution may split; no node's neighbours are ever collected into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def _undirected(edges: DataFrame) -> DataFrame:
    """(a, b) both ways, without loops and repeats."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a != b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour v > u of u is hung on the least of u and its neighbours."""
    both = _undirected(edges)
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour v <= u of u, and u itself, is hung on the least of them."""
    down = _undirected(edges).where("b < a")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that is an end of an edge (a, b), and the least node of its component.

    Nulls in ``a`` or ``b`` are no edges; loops and repeated edges change nothing.  No edges give no rows; a node that
    is not in ``edges`` is not in the result (it is its own root).
    """
    current = kept(edges.where("a is not null and b is not null").select("a", "b"), "edges")
    while True:
        current = kept(_small_star(_large_star(current)), "edges")
        # stars: no node is both a leaf and a centre, and each leaf has one centre
        leaves = current.select(F.greatest("a", "b").alias("leaf"), F.least("a", "b").alias("centre"))
        centred = leaves.groupBy("leaf").agg(F.countDistinct("centre").alias("n")).where("n > 1")
        both = leaves.select(F.col("leaf").alias("node")).join(leaves.select(F.col("centre").alias("node")), "node", "left_semi")
        if centred.isEmpty() and both.isEmpty():
            break
    roots = current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    centres = roots.select(F.col("root").alias("node"), "root").distinct()
    return roots.unionByName(centres).distinct()
