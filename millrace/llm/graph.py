"""Connected components by alternating large-star and small-star rounds, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C


#: Edges up to which the minima of their nodes, at most two for each edge, are broadcast.
FEW = 500_000


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first())


def _with(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """edges with the table of minima; both sides of a shuffled join are plain tables, so that Spark can split a hot node's rows."""
    return edges.join(F.broadcast(least) if few else C.cut(least), "u")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with(both, least, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with(edges, least, few).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) of every node that has an edge; component is the least id that can be reached.

    edges: pairs (a, b) in any order; loops and repeats do no harm. A node's neighbours are never gathered: each round takes their minimum with partial
    aggregation and joins it back: broadcast while the edges are FEW, and else in a join where Spark can split a hot node's rows.
    """
    e = C.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(e)
    for _ in range(most):
        if not before[0]:
            break
        few = before[0] <= FEW
        e = C.cut(_small_star(C.cut(_large_star(e, few)), few))
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
