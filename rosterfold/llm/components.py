"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterfold.llm.shared import pinned


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join the neighbours of every node to its smallest one: the larger neighbours, or the node and its smaller ones."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # A node of very many neighbours: minima are combined before the shuffle, and large partitions of the join are split.
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = sides.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether every node has one neighbour above it or some below it, but not both."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up = 1 and down > 0")
    return not odd.head(1)


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node it is connected with, for every node of ``edges`` (a, b: bigint)."""
    edges = pinned(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _flat(edges):
        edges = pinned(_star(pinned(_star(edges, True), "large-star"), False), "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b"))).distinct()
