"""Name search and lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import like_pattern


def search(entities: DataFrame, q: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose name holds q, case aside, the first by id; a blank q finds nothing. With a kind, the partition of that
    kind alone is read. Without wildcards the test is a plain contains on a stored lower-case name, if there is one."""
    q = q.strip()
    out = entities.where(F.col("kind") == kind) if kind else entities
    if not q:
        return out.limit(0)
    if "name_lc" in entities.columns and not set(q) & set("%_\\"):
        out = out.where(F.col("name_lc").contains(q.lower()))
    else:
        out = out.where(F.col("name").ilike(like_pattern(q)))
    return out.orderBy("id").limit(limit)


def list_entities(entities: DataFrame, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The first entities by id, of one kind if given; limit is held between 1 and 200."""
    out = entities.where(F.col("kind") == kind) if kind else entities
    return out.orderBy("id").limit(min(max(limit, 1), 200))


def list_edges(edges: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """The first edges, of one type if given; limit is held between 1 and 500."""
    out = edges.where(F.col("type") == kind) if kind else edges
    return out.orderBy("type", "src_id", "dst_id").limit(min(max(limit, 1), 500))


def matching(df: DataFrame, ids: list[str], columns: tuple[str, ...] = ("mesh_id", "mesh_ids", "mesh_terms")) -> DataFrame:
    """Rows whose first present column of these is in ids (an array: holds one of them); all rows if there is none."""
    for name in columns:
        if name in df.columns:
            if df.schema[name].dataType.typeName() == "array":
                return df.where(F.arrays_overlap(F.col(name), F.array(*(F.lit(i) for i in ids)))) if ids else df.limit(0)
            return df.where(F.col(name).isin(ids))
    return df


def as_json(df: DataFrame) -> DataFrame:
    """The rows as JSON objects, one line each, nulls included: what an endpoint answers with, or writes with write.text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def token_index(entities: DataFrame) -> DataFrame:
    """token and id: the lower-case words (runs of letters and digits) of each name, once an entity."""
    words = F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return entities.select(F.explode(F.array_distinct(words)).alias("token"), "id")


def search_tokens(index: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """The first ids whose names hold all words of q, in any order; a q without words finds nothing."""
    wanted = sorted({w for w in re.split(r"[\W_]+", q.lower()) if w})
    found = index.where(F.col("token").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return found.select("id").orderBy("id").limit(limit if wanted else 0)
