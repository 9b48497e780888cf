"""Connected components by alternating stars, on shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.sources.tables import discard, read_back, write_aside


def _stars(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest of its neighbourhood, then its smaller ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    large = (
        both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    ).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(low, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.unionByName(low.withColumnRenamed("low", "b")).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of undirected ``edges`` (``a, b``); the root is its smallest node.

    Every round writes its edges to the shared folder and drops those of the round before, so a lost
    executor costs one round at most. The rounds end when every edge ends at a root; their number grows
    with the logarithm of the longest path. Hubs are only ever summed up and joined, never gathered.
    """
    spark = edges.sparkSession
    schema = edges.schema
    one_way = edges.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    path = write_aside(one_way.distinct(), "edges")
    now = read_back(spark, path, schema)
    while not _is_settled(now):
        following = write_aside(_stars(now), "edges")
        now = read_back(spark, following, schema)
        discard(spark, path)
        path = following
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _is_settled(edges: DataFrame) -> bool:
    """Each node has one edge, and no end of an edge has an edge of its own."""
    ends = edges.select(F.col("b").alias("a")).distinct()
    chained = edges.join(ends, "a", "left_semi")
    repeated = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
    return chained.isEmpty() and repeated.isEmpty()
