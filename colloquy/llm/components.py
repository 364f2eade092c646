"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.session import staged

MAX_ROUNDS = 60


def _oriented(edges: DataFrame) -> DataFrame:
    return (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a > b").distinct())


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _round(edges: DataFrame) -> DataFrame:
    """Hang every node's larger neighbours on the smallest of its neighbourhood,
    then do the same with the smaller ones."""
    both = _both(edges)
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = (both.filter("b > a").join(lowest, "a")
             .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = (large.join(lowest, "a").filter("b > m")
             .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return small.unionByName(lowest.withColumnRenamed("m", "b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs directly on a node that hangs on none."""
    if edges.groupBy("a").count().filter("count > 1").take(1):
        return False
    return not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").take(1)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges (a, b)`` other than the roots;
    the root is the smallest node of the component.

    Minimums come from partial aggregation and joins are inner joins that
    adaptive execution can split, so a node with many links needs no task of its
    own. The table is written after each round; a few rounds suffice, since
    the distance to the root falls by a factor in each.
    """
    edges = staged(_oriented(edges), "links")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = staged(_round(edges), "links")
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
