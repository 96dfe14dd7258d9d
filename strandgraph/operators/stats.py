"""Counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_kind(entities: DataFrame) -> DataFrame:
    """kind and count, the largest first; a null kind is a group."""
    return entities.groupBy("kind").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "kind")


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"))


def stats(entities: DataFrame, edges: DataFrame) -> dict:
    return {"entities": {r["kind"]: r["count"] for r in by_kind(entities).collect()}, "edges": edge_count(edges).first()["edges"]}


def health(spark: SparkSession) -> dict:
    return {"status": "healthy" if spark.range(1).count() == 1 else "unhealthy"}
