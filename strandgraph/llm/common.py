"""Shared helpers of the training-data operators: staging tables in the shared folder and safe column access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_OWN: dict[str, str] = {}


@dataclass(frozen=True)
class Staged:
    """Where a staged table lies: not the table, whose plan and file listing the driver would hold as long."""

    staged_path: str


#: Staged tables that have not been dropped, in the order of their making.
_STAGED: list[Staged] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one temporary folder an application where none is set and the
    master is local (tests). On a cluster a missing setting is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="strandgraph-")
        found = _OWN[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/strandgraph/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    tidy()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    _STAGED.append(Staged(path))
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        delete(table.sparkSession, table.staged_path)


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _STAGED[:] = [t for t in _STAGED if t.staged_path != name]


def staged() -> int:
    """How many staged tables there are: what sweep() starts from."""
    return len(_STAGED)


def sweep(since: int, keep: DataFrame) -> None:
    """Delete the tables staged since then but for one: what they were made for has been written to it."""
    for table in _STAGED[since:]:
        if table.staged_path != keep.staged_path:
            delete(keep.sparkSession, table.staged_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df already has a column of that name (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def free_names(keep: list[str], *names: str) -> tuple[str, ...]:
    """names, each with underscores before it if keep, or another of them, has that name (case aside)."""
    taken, out = {c.lower() for c in keep}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def tidy() -> None:
    """Give memory that is free back to the system: a worker outlives its task, beside the next task's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc here
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, tidied up after each task."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(whole, schema)


def map_rows(df: DataFrame, keep: list[str], fields: T.StructType, make) -> DataFrame:
    """Columns keep of df, unchanged, followed by new ones that make()(batch) returns as Arrow arrays, batch by batch.

    make runs once a task, so that what it builds (an automaton, a dictionary) is shared by the task's batches.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    places, names = [df.columns.index(c) for c in keep], schema.names

    def run(batches):
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *work(batch)], names=names)

    return map_arrow(df, run, schema)


def squeezed(docs: DataFrame, text: str) -> DataFrame:
    """docs with the text as Zstandard frames: what a shuffle then moves is a third."""
    place, names = docs.columns.index(text), docs.columns
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if i == place else f for i, f in enumerate(docs.schema.fields)])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([None if t is None else pack(t.encode() if isinstance(t, str) else t) for t in columns[place].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs, run, schema)
