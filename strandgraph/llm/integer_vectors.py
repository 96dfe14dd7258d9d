"""Vectors as integers, exact distances between them, and joins that split frequent keys: what op11 and op13 share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this have squared distances that no long holds; vectors with such components are treated as non-finite.
LARGEST = 1 << 26
#: A key with at least one in so many of all rows is frequent; there are at most so many of them.
FREQUENT = 1024


def integers(vector: Column, scale: int, dims: int) -> tuple[Column, Column]:
    """(whether the vector has dims components, all finite and in range, its components as floor(scale * x))."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(F.lit(float(scale)) * x.cast("double")) < float(LARGEST)))
    whole = F.coalesce(vector.isNotNull() & (F.size(vector) == dims) & good, F.lit(False))
    return whole, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).reshape(-1), kind))


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of each row of x to each row of y (integers, at most LARGEST in size)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # then every sum below is an integer that a double holds
        a, b = x.astype(np.float64), y.astype(np.float64)
        out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        return out.astype(np.int64)
    a, b = x.astype(np.int64), y.astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for j in range(len(b)):
        out[:, j] = ((a - b[j]) ** 2).sum(axis=1)
    return out


def split_join(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows with the columns of found, which has one row for each key of rows (null is a key) and, in weight, how many of the
    total rows have it. Frequent keys, at most FREQUENT for each weighed set, are broadcast; the others are joined by shuffle."""
    names = [f"_{k}" for k in keys]
    table = found.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *(c for c in found.columns if c not in (*keys, weight)), (F.col(weight).cast("decimal(38,0)") * FREQUENT >= total).alias("_often"))
    on = [rows[k].eqNullSafe(table[n]) for k, n in zip(keys, names)]
    often, rare = table.where("_often").drop("_often"), table.where("NOT _often").drop("_often")
    met = rows.join(F.broadcast(often.withColumn("_met", F.lit(True))), on, "left")
    new = [c for c in often.columns if c not in names]
    others = met.where("_met IS NULL").select(*rows.columns)
    rest = others.join(rare, [others[k].eqNullSafe(rare[n]) for k, n in zip(keys, names)])
    return met.where("_met").select(*rows.columns, *new).unionByName(rest.select(*rows.columns, *new))
