"""Entities and edges laid out so that reading the graph shuffles nothing.

Entities are bucketed and sorted by id, edges by the node they start from, in as many buckets, with the name of the node they end at
written beside it. So naming both ends of edges, and following a frontier of nodes to their edges, is a join of buckets. Keys have
Parquet bloom filters, so that a lookup of one node skips the row groups that do not hold it. The layout is made from published
tables and made anew when they change; tables live in the session's catalog, in the shared warehouse.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bucketed(df: DataFrame, name: str, by: str, buckets: int, keys: list[str]) -> DataFrame:
    """df as a table of the catalog, in buckets by a column, sorted by it, with bloom filters on keys."""
    out = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).format("parquet")
    for key in keys:
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
    out.saveAsTable(name)
    return df.sparkSession.table(name)


@dataclass
class GraphLayout:
    spark: SparkSession
    name: str

    @classmethod
    def build(cls, entities: DataFrame, edges: DataFrame, name: str | None = None, buckets: int | None = None) -> GraphLayout:
        """Write both tables. Edges without one of their ends are left out; buckets: by default as many as shuffles have partitions."""
        spark = entities.sparkSession
        name = name or f"graph_{uuid.uuid4().hex}"
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        ents = bucketed(entities.select("id", "kind", "name"), f"{name}_entity", "id", n, ["id"])
        ends = ents.select(F.col("id").alias("dst_id"), F.col("name").alias("dst_name"))
        bucketed(edges.join(ends, "dst_id").select("type", "src_id", "src_kind", "dst_id", "dst_kind", "dst_name", "score"), f"{name}_edge", "src_id", n, ["src_id", "dst_id"])
        return cls(spark, name)

    @property
    def entities(self) -> DataFrame:
        return self.spark.table(f"{self.name}_entity")

    @property
    def edges(self) -> DataFrame:
        return self.spark.table(f"{self.name}_edge")

    def decorated(self, min_score: float | None = None) -> DataFrame:
        """Edges with the names of both ends, and a score of 0 for none: what operators.graph.decorated makes of the tables."""
        edges = self.edges if min_score is None else self.edges.where(F.coalesce("score", F.lit(0.0)) >= min_score)
        names = self.entities.select(F.col("id").alias("src_id"), F.col("name").alias("src_name"))
        return edges.join(names, "src_id").select("type", "src_id", "src_name", "src_kind", "dst_id", "dst_name", "dst_kind", F.coalesce("score", F.lit(0.0)).alias("score"))

    def drop(self) -> None:
        for part in ("entity", "edge"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
