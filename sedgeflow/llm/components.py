"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeflow.llm.common import drop, shared_dir, stage


def _large_star(edges: DataFrame, path: str) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of the node and its neighbours, which
    is written first: a join of plain sides is one that adaptive execution can split."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), path)
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, are tied to its least neighbour. Here a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """node, component (the least node that it reaches) for every node that is not the least of its
    component. edges has two columns of longs; loops and repeats are allowed.

    Each round is a written table in the shared folder, so lost executors cost no more than the
    round at hand; what a round was made from is dropped. Nodes are aggregated before they are shuffled and joins are plain ones, which
    adaptive execution splits where a node is hot. Only counts and checksums reach the driver.
    """
    folder = folder or shared_dir(edges.sparkSession)
    x, y = edges.columns
    a, b = F.greatest(x, y), F.least(x, y)
    current = stage(edges.where(F.col(x) != F.col(y)).select(a.cast("long").alias("a"), b.cast("long").alias("b")).distinct(), f"{folder}/edges-0")
    mark, k = None, 0
    while True:
        seen = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if seen[0] == 0 or seen == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark, k = seen, k + 1
        current = stage(_small_star(_large_star(current, f"{folder}/least-{k}")), f"{folder}/edges-{k}")
        drop(edges.sparkSession, f"{folder}/least-{k}", f"{folder}/edges-{k - 1}")
