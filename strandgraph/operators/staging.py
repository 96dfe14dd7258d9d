"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Rows that one task sorts or groups, about.
TASK_ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one temporary folder an application where none is set and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not found:
            found = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="strandgraph-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandgraph/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession, size: int, each: int = TASK_ROWS) -> int:
    """As many partitions as hold about `each` of `size` rows, and no fewer than shuffles have: so a task's memory does not grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def dealt(df: DataFrame, parts: int | None, *keys: str | Column) -> DataFrame:
    """df dealt by keys over so many partitions, where these are more than shuffles have; else shuffles do."""
    return df.repartition(parts, *keys) if parts and parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: its lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
