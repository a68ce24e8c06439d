"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest id reachable) of every node that ``links`` (``a, b``) names.

    Neighbourhoods are only ever aggregated to their least member and joined, so a node of any degree is no bottleneck. The
    steps end when every edge leads to a root, after a number of rounds logarithmic in the nodes.
    """
    edges = materialised(_distinct(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    while True:
        # large star: every larger neighbour of a node is tied to the least of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _distinct(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialised(large)
        # small star: a node and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialised(_distinct(small))
        roots = new.select(F.col("v").alias("u")).groupBy("u").agg(F.lit(1).alias("one"))
        many = new.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        edges = new
        if new.join(roots, "u", "left_semi").isEmpty() and many.isEmpty():
            break
    tops = edges.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return materialised(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops))
