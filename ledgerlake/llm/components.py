"""Connected components of an edge list by alternating stars; every round ends in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(pairs: DataFrame, at: str, other: str) -> DataFrame:
    """pairs with the least of each node and its others; summed before the shuffle, and a join that skewed nodes can split."""
    least = pairs.groupBy(at).agg(F.min(other).alias("m")).withColumn("m", F.least(at, "m"))
    return pairs.join(least, at)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for the nodes of edges (u, v): component is the least node reachable.

    Large star: each node hands its larger neighbours to its least neighbour. Small star: each hands its smaller ones, and
    itself, to its least. Together they end in stars around the least nodes after O(log^2 n) rounds; a node's neighbours are
    never gathered. Loops and repeated edges do no harm; an empty list gives an empty table.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large, "u", "v")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node")))
