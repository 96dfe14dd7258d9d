"""Substring search by a table of trigrams, so that a search with a wildcard in front reads few postings instead of all names.

A name, written small and followed by two end marks, gives its distinct runs of three characters, each with the entity's id. The table
is laid out by a hash of a run's first two characters and sorted by run. A pattern's literal parts say which runs a match must hold:
all runs of parts of three characters or more; of shorter parts any run that begins with them (the end marks see to the last ones).
Entities that have all of them are then held against the pattern itself. A pattern without a literal part reads the names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import like_pattern
from .staging import dealt, new_path, partitions

SIZE, END = 3, "\x00"
#: Partitions of the table, by the first two characters.
LEADS = 64
#: Postings that one task sorts, about.
TASK_POSTINGS = 1 << 21


def lead(gram: Column) -> Column:
    return F.pmod(F.crc32(F.substring(gram, 1, 2).cast("binary")), F.lit(LEADS)).cast("int")


def postings(entities: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """gram and id: each run of a name once. Null and empty names have none."""
    padded = F.concat(F.lower(name), F.lit(END * (SIZE - 1)))
    runs = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(padded, i, F.lit(SIZE)))
    return entities.where(F.length(name) > 0).select(F.explode(F.array_distinct(runs)).alias("gram"), F.col(key).alias("id"))


def literal_parts(q: str) -> list[str]:
    """The literal parts of the pattern %q%, written small; a backslash takes the wildcard's meaning from what follows it."""
    parts, part, pattern = [], "", like_pattern(q)
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            part, i = part + pattern[i + 1], i + 1
        elif c in "%_":
            parts, part = [*parts, part], ""
        else:
            part += c
        i += 1
    return [p.lower() for p in [*parts, part] if p]


def wanted(q: str) -> tuple[list[str], list[str]]:
    """(runs that a match holds, beginnings of which it holds a run each)."""
    parts = literal_parts(q)
    whole = sorted({p[i : i + SIZE] for p in parts for i in range(len(p) - SIZE + 1)})
    short = sorted({p for p in parts if len(p) < SIZE and not any(p in other for other in parts if len(other) >= SIZE)})
    return whole, short


@dataclass
class TrigramIndex:
    """The table (gram, id, lead) in a folder of the shared store, of so many parts."""

    spark: SparkSession
    path: str
    parts: int | None = None

    @classmethod
    def build(cls, entities: DataFrame, path: str | None = None, key: str = "id", name: str = "name") -> TrigramIndex:
        path = path or new_path(entities.sparkSession, "trigrams")
        spark = entities.sparkSession
        rows = postings(entities, key, name).withColumn("lead", lead(F.col("gram")))
        # Ranges with the id in them cut even one run's postings, however many; they are counted by the lengths of names.
        parts = partitions(spark, entities.agg(F.coalesce(F.sum(F.length(name)), F.lit(0))).first()[0], TASK_POSTINGS)
        rows.repartitionByRange(parts, "lead", "gram", "id").sortWithinPartitions("lead", "gram", "id").write.partitionBy("lead").parquet(path)
        return cls(spark, path, parts)

    def table(self, id_type: str = "long") -> DataFrame:
        return self.spark.read.schema(f"gram string, id {id_type}, lead int").parquet(self.path)

    def candidates(self, q: str) -> DataFrame | None:
        """Ids whose names hold all that q asks for; None if it asks for nothing. Only postings of those runs are read."""
        whole, short = wanted(q)
        if not whole and not short:
            return None
        gram = F.col("gram")
        asked = [gram == g for g in whole] + [gram.startswith(p) for p in short]
        here = gram.isin(whole) if whole else F.lit(False)
        for p in short:
            here = here | gram.startswith(p)
        rows = self.table().where(here)
        if all(len(p) > 1 for p in short):
            rows = rows.where(F.col("lead").isin(sorted({zlib.crc32(p[:2].encode()) % LEADS for p in [*whole, *short]})))
        held = dealt(rows, self.parts, "id").groupBy("id").agg(*(F.bool_or(a).alias(f"h{i}") for i, a in enumerate(asked)))
        return held.where(" AND ".join(f"h{i}" for i in range(len(asked)))).select("id")


def search(index: TrigramIndex, entities: DataFrame, q: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """What operators.search.search finds: entities whose name matches %q%, case aside, the first by id."""
    q = q.strip()
    out = entities.where(F.col("kind") == kind) if kind else entities
    if not q:
        return out.limit(0)
    found = index.candidates(q)
    if found is not None:
        out = out.join(found, "id", "left_semi")
    return out.where(F.col("name").ilike(like_pattern(q))).orderBy("id").limit(limit)
