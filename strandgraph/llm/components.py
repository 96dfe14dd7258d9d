"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def _minimum(edges: DataFrame) -> DataFrame:
    """For each node a of edges (a, b), the least of itself and its neighbours."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b), in any direction, repeated or not, to (node, component): the least node that can be reached.

    Each round replaces every node's links by links to the least node it knows of; after some log(n) ** 2 rounds at
    most, and two or three for star-like groups, nothing changes. A round's links are written to a table in the shared
    folder. A node with very many links is only ever joined to its one minimum.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_minimum(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = stage(large, "links")
        # small star: every node links its smaller neighbours, and itself, to the least of them
        tied = large.join(_minimum(large), "a")
        small = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).where("a <> b").distinct()
        small = stage(small, "links")
        same = not small.join(edges, ["a", "b"], "left_anti").take(1) and not edges.join(small, ["a", "b"], "left_anti").take(1)
        drop(edges, large)
        edges = small
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
