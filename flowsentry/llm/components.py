"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import settle


def _stars(both: DataFrame, larger: bool) -> DataFrame:
    """Tie the neighbours of each node to the smallest among it and them.

    A large star re-ties the neighbours above the node, a small star those below it and the node itself.
    """
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if larger:
        tied = joined.where("b > a").select(F.col("b").alias("x"), "m")
    else:
        below = joined.where("b < a")
        tied = below.select(F.col("b").alias("x"), "m").unionByName(below.select(F.col("a").alias("x"), "m"))
    return tied.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``; the component is its smallest node.

    The number of rounds grows with the logarithm of the longest path. Each round is written, so that
    neither plan nor lineage grows; a node with many neighbours only takes part in joins, which split.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        large = settle(_stars(_both_ways(edges), True), "stars")
        edges = settle(_stars(_both_ways(large), False), "stars")
        # Sums of hashes tell whether a round changed anything.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
