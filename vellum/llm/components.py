"""Connected components of a large graph as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating star rounds: each round links every larger neighbour to the
    smallest one, then every smaller one, until nothing changes (a number of
    rounds that grows with the logarithm of the graph). A round is a minimum
    per node, combined before its shuffle, and a join, whose hot nodes AQE
    splits. Each round's edges are written to the shared folder.
    """
    def compact(e: DataFrame) -> DataFrame:
        return store(e.where("a <> b").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = compact(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = compact(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e = compact(small.union(low))
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select("b", F.col("b")).distinct())
