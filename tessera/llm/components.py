"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import apart, cut, merged


def stars(edges: DataFrame) -> bool:
    """Whether each node a has one b, and no b has one itself. edges: distinct, a > b."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or up = 1 and n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge to another, with its component's least node as root.

    edges: columns a and b of one orderable type. A node's neighbours are only ever aggregated, never gathered, and the number
    of rounds grows with the logarithm of the longest path. No edges give no rows. Nothing is broadcast, so that the driver holds no
    part of the graph."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = merged(apart(edges, "b"), apart(least, "b"), ["b", "apart"]).select("a", F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = merged(apart(large, "a"), apart(least, "a"), ["a", "apart"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
