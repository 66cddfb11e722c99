"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aislewise.session import released, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the smallest node of each node's component.

    Nodes without a link are absent; null ends and self-links are ignored. Every round is
    written to the shared folder, so the lineage stays short and a lost executor costs a
    re-read. Only two numbers per round reach the driver. Rounds grow as the logarithm of the
    longest chain of links; all grouping is by minimum, which Spark combines before a shuffle.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        large = stored(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lowest.select("a", F.col("m").alias("b"))))
        replaced, edges = edges, stored(small.distinct())
        released(replaced)
        released(large)
        after = _state(edges)
        if after == before:
            break
        before = after
    # Every edge now leads from a node to its component's smallest node.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
