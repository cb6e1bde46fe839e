"""Connected components of a large sparse graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import common


def settled(edges: DataFrame) -> bool:
    """Whether each node a of edges (a, b) hangs on one root b that hangs on none."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs")))
    ends = nodes.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least"))
    return not ends.where("hangs > 1 or (hangs = 1 and least = 0)").head(1)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge in edges (a long, b long) but the roots: a root is its component's least node.

    Each round hangs a node's larger neighbours on the least of its neighbourhood, and then its smaller ones, until
    every node hangs directly on its root; a node's path shortens by half or so each time. Every round is written to
    the shared folder.
    """
    ab = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.written(ab, "star")
    for _ in range(rounds):
        if settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.withColumnRenamed("m", "b")).where("a <> b").distinct()
        after = common.written(hung, "star")
        common.dropped(now)
        now = after
    raise RuntimeError("components did not settle")
