"""Connected components by alternating stars, on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import table


def components(edges: DataFrame) -> DataFrame:
    """``v, c``: every node of ``edges(a, b)`` (longs) with the least node of its component.

    Each round connects the neighbours of a node to its least neighbour, first the larger ones, then the
    smaller ones. Nodes and edges stay in tables; a node of many edges is only an aggregate and a join.
    """
    edges = table(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = ends.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = table(small.filter("a <> b").distinct())
    own = edges.select(F.col("b").alias("v")).distinct().select("v", F.col("v").alias("c"))
    return table(edges.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(own))
