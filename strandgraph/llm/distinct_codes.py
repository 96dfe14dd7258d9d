"""Product codes of vectors, learned on distinct parts: equal integer parts are one weighted row.

Vectors become integers and are cut into PARTS equal parts. At each part position, equal parts are counted once and for all:
(position, part, weight) is one table, smaller than the vectors by what repeats. Weighted Lloyd rounds run over that table alone:
executors assign its rows to the position's nearest codebook entry, weighted sums by entry are combined before the shuffle,
and the driver holds the codebooks, PARTS * ENTRIES entries whatever the input. The last assignment is joined back by part.

A part that a large share of all vectors has is one row of that table, so no task holds its copies. In the join back such parts,
at most FREQUENT a position, are broadcast and so never shuffled; the others are joined by shuffle. Sums by label are joined back alike.

Defined results: vectors that are null, have another number of components than DIMS, or hold a null, non-finite or too large
component (integers beyond 2 ** 26, whose squared distances no long holds) are dropped; codebooks start with the smallest vec_ids,
of equal ones the smallest vector, null vec_ids last; fewer vectors than entries make fewer entries; repeated rows stay rows;
null labels are one label; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, map_arrow, stage
from .integer_vectors import integers, rows_of, split_join, squared_distances

DIMS, PARTS, ENTRIES, ROUNDS, SCALE = 64, 16, 64, 2, 256


@dataclass
class Codes:
    """rows: vec_id, label, codes (array of entry numbers in part order), error. codebooks: integers by part, entry, place."""

    rows: DataFrame
    codebooks: np.ndarray


def nearest(parts: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """parts (position, part, weight) with code and distance: each row's nearest entry at its position, ties to the least."""
    width = codebooks.shape[2]

    def run(batches):
        for batch in batches:
            position, part = batch.column(0).to_numpy(), rows_of(batch.column(1), width)
            code, distance = np.zeros(len(position), np.int32), np.zeros(len(position), np.int64)
            for p in np.unique(position).tolist():
                at = np.flatnonzero(position == p)
                found = squared_distances(part[at], codebooks[p])
                code[at] = found.argmin(axis=1)
                distance[at] = found.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(distance)], names=["position", "part", "weight", "code", "distance"])

    return map_arrow(parts, run, "position int, part array<int>, weight long, code int, distance long")


def moved(assigned: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' weighted mean; unused entries stay."""
    width = codebooks.shape[2]
    weight = F.col("weight").cast("decimal(20,0)")
    sums = [F.sum(F.col("part")[i].cast("decimal(10,0)") * weight).alias(f"s{i}") for i in range(width)]
    out = codebooks.copy()
    for r in assigned.groupBy("position", "code").agg(F.sum(weight).alias("n"), *sums).collect():
        out[r["position"], r["code"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(width)]
    return out


def encode(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    width = dims // parts
    whole, x = integers(F.col(vector), scale, dims)
    kept = stage(vectors.where(whole).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), x.alias("x"), F.monotonically_increasing_id().alias("row")), "vectors")
    first = kept.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    total = kept.count()
    codebooks = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    cut = kept.select("row", "vec_id", "label", F.posexplode(F.array(*(F.slice("x", p * width + 1, width) for p in range(parts)))).alias("position", "part"))
    distinct = stage(cut.groupBy("position", "part").agg(F.count("*").alias("weight")), "parts")
    for _ in range(rounds if first else 0):
        codebooks = moved(nearest(distinct, codebooks), codebooks)
    coded = stage(nearest(distinct, codebooks), "coded")
    each = split_join(cut, coded, ["position", "part"], "weight", total)
    rows = each.groupBy("row", "vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("position", "code"))).alias("codes"), F.sum("distance").alias("error"))
    rows = stage(rows.select("vec_id", "label", F.transform("codes", lambda c: c["code"]).alias("codes"), "error"), "codes")
    drop(kept, distinct, coded)
    return Codes(rows, codebooks)


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with label_error: the error summed over equal labels, nulls together."""
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n"))
    return split_join(rows, sums, ["label"], "n", rows.count())


def digest(codes: Codes) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    sha = hashlib.sha256(",".join(map(str, codes.codebooks.reshape(-1).tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_error(codes.rows).select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
