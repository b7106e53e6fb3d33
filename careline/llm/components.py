"""Connected components by alternating stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careline.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    around = _both_ways(edges)
    least = (around.groupBy("u").agg(F.min("v").alias("m"))
             .select("u", F.least("u", "m").alias("m")))
    return (around.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are hung on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (edges.join(least, "u").filter("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link to another one.

    `component` is the smallest node reachable. Links may come in either direction and
    repeatedly; links of a node with itself and links with NULL say nothing. Each round
    is written to the shared folder; rounds grow with the logarithm of the longest chain.
    The driver sees two numbers a round.
    """
    x, y = F.col(a), F.col(b)
    current = written(edges.filter(x != y).select(F.greatest(x, y).alias("u"),
                                                  F.least(x, y).alias("v")).distinct(), "links")
    before = _signature(current)
    while before[0]:
        current = written(_small_star(_large_star(current)), "stars")
        now = _signature(current)
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
