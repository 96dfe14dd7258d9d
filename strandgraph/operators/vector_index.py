"""Nearest neighbours by cosine, for many queries at once, over an index of cells.

Vectors are scaled to length one. Cells are k-means centroids, fitted on the driver over a bounded sample (SAMPLE rows by a hash of
the key); every row of the table belongs to its nearest one, and each cell's radius and size are known. A search compares a query
with the rows of its nearest cells. An exact search then goes on to each further cell that could hold a nearer row: one whose
distance less its radius is not beyond the query's k-th neighbour so far (by the triangle inequality), so its answer is that of
comparing all rows.

Rows and queries of a cell are dealt in blocks, so that a large cell is the work of many tasks; a block hands on k rows a
query. Null vectors, those of length zero and those with a null or non-finite component have no direction and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import written

#: Rows that cells are fitted on, cells at most, and rounds of the fit.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 10
#: Queries by which the number of cells to look at is chosen.
TUNED = 200
ROW_BLOCK, QUERY_BLOCK, STEP = 65_536, 2048, 2048
#: Distances that a task holds at once, and probes that it hands on at once.
HELD, HANDED = 1 << 20, 8192
#: Similarities are compared as they are shown, to so many digits; ties go to the least key.
DIGITS = 6


def unit(vector: Column) -> Column:
    """The vector at length one, as doubles; null if it has no direction."""
    x = F.transform(vector, lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    fine = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & (length > 0)
    return F.when(fine, F.transform(x, lambda v: v / length))


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def fitted(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of a sample, by k-means from evenly spread rows."""
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centroids)[0]
        n = np.bincount(own, minlength=cells)
        for c in np.flatnonzero(n):
            centroids[c] = x[own == c].mean(axis=0)
    return centroids


def slices(batches, cells: int):
    """Batches cut into slices whose distances from so many cells are HELD at most."""
    step = max(1, HELD // max(cells, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def handed(batch: pa.RecordBatch, at: np.ndarray, cells: np.ndarray):
    """query, unit and cell of a batch's queries (query, unit) at `at`, HANDED rows at a time: each carries its vector."""
    for lo in range(0, len(at), HANDED):
        rows = pa.array(at[lo : lo + HANDED])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(cells[lo : lo + HANDED].astype(np.int32))], names=["query", "unit", "cell"])


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and its distance."""
    apart = distances(x, centroids)
    own = apart.argmin(axis=1)
    return own, apart[np.arange(len(x)), own]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class VectorIndex:
    """rows (key, unit, cell), written; centroids, and each cell's radius and number of rows."""

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """cells: by default the root of the number of rows, MOST_CELLS at most."""
        flat = vectors.select(F.col(key).alias("key"), unit(F.col(vector)).alias("unit")).where("unit IS NOT NULL")
        picked = flat.orderBy(F.xxhash64("key"), "unit").limit(sample).collect()
        if not picked:
            return cls(flat.withColumn("cell", F.lit(0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64))
        x = np.array([r["unit"] for r in picked])
        k = min(len(x), cells or max(1, min(MOST_CELLS, round(flat.count() ** 0.5))))
        centroids = fitted(x, k)

        def assign(batches):
            for batch in slices(batches, k):
                if batch.num_rows:
                    own, apart = nearest(matrix(batch.column(1)), centroids)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(apart)], names=["key", "unit", "cell", "apart"])

        kind = flat.schema["key"].dataType.simpleString()
        rows = written(flat.mapInArrow(assign, f"key {kind}, unit array<double>, cell int, apart double"), "cells")
        radius, size = np.zeros(k), np.zeros(k, np.int64)
        for r in rows.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect():  # a row a cell
            radius[r["cell"]], size[r["cell"]] = r["radius"], r["n"]
        return cls(rows.drop("apart"), centroids, radius, size)

    def probes(self, queries: DataFrame, cells: int) -> DataFrame:
        """query, unit and cell: each query with its nearest cells that have rows."""
        centroids, used = self.centroids, np.flatnonzero(self.size)

        def run(batches):
            for batch in slices(batches, len(used)):
                if batch.num_rows:
                    order = used[np.argsort(distances(matrix(batch.column(1)), centroids[used]), axis=1, kind="stable")[:, :cells]]
                    at = np.repeat(np.arange(len(order)), order.shape[1])
                    yield from handed(batch, at, order.reshape(-1))

        return queries.mapInArrow(run, self.probe_schema(queries))

    @staticmethod
    def probe_schema(queries: DataFrame) -> str:
        return f"query {queries.schema['query'].dataType.simpleString()}, unit array<double>, cell int"

    def further(self, queries: DataFrame, cells: int) -> DataFrame:
        """query, unit and cell of queries (query, unit, least: the similarity to beat, or null): cells beyond the nearest that could
        hold a row as near."""
        centroids, radius, used = self.centroids, self.radius, np.flatnonzero(self.size)

        def run(batches):
            for batch in slices(batches, len(used)):
                if not batch.num_rows:
                    continue
                apart = distances(matrix(batch.column(1)), centroids[used])
                order = np.argsort(apart, axis=1, kind="stable")
                least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(2 - 2 * (least - 10.0**-DIGITS), 0)) + 1e-7)
                open_ = apart - radius[used][None, :] <= reach[:, None]
                np.put_along_axis(open_, order[:, :cells], False, axis=1)
                at, cell = np.nonzero(open_)
                yield from handed(batch, at, used[cell])

        return queries.select("query", "unit", "least").mapInArrow(run, self.probe_schema(queries))

    def compared(self, probes: DataFrame, k: int) -> DataFrame:
        """query, key and similarity: of each probe's cell, block by block, the k rows most like the query, itself left out."""
        kind = self.rows.schema["key"].dataType.simpleString()
        # Sizes of cells, MOST_CELLS rows, and of what is asked of them, are broadcast.
        sizes = self.rows.sparkSession.createDataFrame([(c, -(-n // ROW_BLOCK)) for c, n in enumerate(self.size.tolist())], "cell int, row_blocks int")
        asked = probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = probes.join(F.broadcast(sizes), "cell").join(F.broadcast(asked), "cell").select("cell", part("query", "query_blocks").alias("qb"), each("row_blocks").alias("rb"), F.lit(0).alias("side"), F.col("query").alias("key"), "unit")
        r = self.rows.join(F.broadcast(sizes), "cell").join(F.broadcast(asked), "cell").select("cell", each("query_blocks").alias("qb"), part("key", "row_blocks").alias("rb"), F.lit(1).alias("side"), "key", "unit")
        dealt = q.unionByName(r).repartition("cell", "qb", "rb").sortWithinPartitions("cell", "qb", "rb", "side")
        return dealt.mapInArrow(lambda batches: _best(batches, k), f"query {kind}, key {kind}, similarity double")

    def search(self, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", probes: int = 8, exact: bool = True) -> DataFrame:
        """query, key, similarity and place (from 1) of each query's k most similar rows, itself left out: among its nearest cells' rows, or,
        if exact, among all. A query without a direction has none."""
        asked = queries.select(F.col(key).alias("query"), unit(F.col(vector)).alias("unit")).where("unit IS NOT NULL").distinct()
        if not len(self.centroids):
            empty = self.rows.select(F.col("key").alias("query"), "key", F.lit(0.0).alias("similarity"), F.lit(1).cast("long").alias("place"))
            return empty.limit(0)
        found = top(self.compared(self.probes(asked, probes), k), k)
        if not exact:
            return found
        found = written(found, "neighbours")
        least = found.where(F.col("place") == k).select("query", F.col("similarity").alias("least"))
        more = self.compared(self.further(asked.join(least, "query", "left"), probes), k)
        return top(found.drop("place").unionByName(more), k)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.9, *, key: str = "vec_id", vector: str = "embedding", sample: int = TUNED) -> int:
        """The fewest cells whose rows hold at least that share of the true neighbours, measured by an exact search of at most `sample`
        of the queries (by a hash of the key)."""
        asked = queries.select(F.col(key).alias(key), F.col(vector).alias(vector)).orderBy(F.xxhash64(key)).limit(sample)
        found = self.search(asked, k, key=key, vector=vector).select("query", "key")
        units = asked.select(F.col(key).alias("query"), unit(F.col(vector)).alias("unit"))
        met = self.rows.select("key", "cell").distinct().join(F.broadcast(found), "key").join(F.broadcast(units), "query").select("unit", "cell").collect()  # sample * k rows
        if not met:
            return 1
        order = np.argsort(distances(np.array([r["unit"] for r in met]), self.centroids), axis=1, kind="stable")
        rank = np.sort((order == np.array([r["cell"] for r in met])[:, None]).argmax(axis=1))
        return int(rank[int(np.ceil(recall * len(rank))) - 1]) + 1


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def _best(batches, k: int):
    """Of sorted blocks (cell, qb, rb, side, key, unit), queries first, each query's k best rows."""
    block, held, queries = None, [], None

    def told():
        if queries is not None and len(queries[2][0]):
            of, sim, keys = queries[2]
            return [pa.RecordBatch.from_arrays([queries[0].take(pa.array(of)), keys, pa.array(sim)], names=["query", "key", "similarity"])]
        return []

    for batch in batches:
        marks = np.stack([batch.column(i).to_numpy() for i in range(4)])
        change = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if tuple(marks[:3, lo].tolist()) != block:
                yield from told()
                block, held, queries = tuple(marks[:3, lo].tolist()), [], None
            if marks[3, lo] == 0:
                held.append(part)
                continue
            if queries is None:
                if not held:
                    continue
                keys = pa.concat_arrays([h.column(4) for h in held])
                places = {}
                for i, key in enumerate(keys.to_pylist()):
                    places.setdefault(key, []).append(i)
                queries = [keys, np.vstack([matrix(h.column(5)) for h in held]), (np.zeros(0, np.int64), np.zeros(0), keys.slice(0, 0)), places]
                held = []
            for at in range(0, part.num_rows, STEP):
                queries[2] = _merged(queries, part.slice(at, STEP), k)
    yield from told()


def _merged(queries: list, rows: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The best of what is held and of more rows: (place of the query, similarity, key), at most k a query."""
    _, x, (of, sim, keys), places = queries
    more = np.round(x @ matrix(rows.column(5)).T, DIGITS)
    for row, key in enumerate(rows.column(4).to_pylist()):
        more[places.get(key, []), row] = -np.inf  # the query itself
    bar = np.partition(more, -k, axis=1)[:, -k] if more.shape[1] > k else np.full(len(more), -np.inf)
    full = np.bincount(of, minlength=len(more)) >= k
    if full.any():  # no row below the worst that is held gets in
        worst = np.full(len(more), np.inf)
        np.minimum.at(worst, of, sim)
        bar = np.where(full, np.maximum(bar, worst), bar)
    at, row = np.nonzero((more >= bar[:, None]) & (more > -np.inf))
    of, sim = np.concatenate((of, at)), np.concatenate((sim, more[at, row]))
    keys = pa.concat_arrays([keys, rows.column(4).take(pa.array(row))])
    ranks = keys.dictionary_encode()
    by_key = np.argsort(np.argsort(np.array(ranks.dictionary.to_pylist(), dtype=object), kind="stable"), kind="stable")[ranks.indices.to_numpy()]
    order = np.lexsort((by_key, -sim, of))
    first = np.concatenate(([True], of[order][1:] != of[order][:-1])) if len(order) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    kept = order[np.arange(len(order)) - begin < k]
    return of[kept], sim[kept], keys.take(pa.array(kept))
