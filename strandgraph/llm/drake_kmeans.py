"""k-means with adaptive bounds: of each vector its nearest centroids with lower bounds, and one bound for all the rest.

A vector's state is its centroid with an upper bound of the distance, the next nearest ones (at most the tracked number) in
order, each with a lower bound, and a remainder bound that holds for every centroid not listed. When centroids move, the upper
bound grows by its centroid's step, the others shrink by theirs, the remainder by the largest step. Read from the far end, the
least bound so far holds for all ranks from there on; so a vector needs exact distances just to the ranks whose bound does not
exceed the upper one: none (after the upper bound is made exact at the latest), some of the listed, or, where the remainder cannot
be certified, all. Ranks that are looked at are put in order again, with exact distances as bounds. The tracked number starts
with a quarter of the centroids, at least 2, and falls to the deepest rank that a round asked for, an eighth of the centroids at least.

Bounds are doubles with a margin of 1e-9 against rounding, and only decide what is looked at: assignments come from exact
integer distances, ties to the smaller number, so they are those of plain Lloyd rounds.

A round is one narrow pass over the written state; the rows it writes hold each task's sums by centroid besides, so that only
these meet in a shuffle. The driver holds the centroids, whose number is a parameter. No vector meets another, so copies make no hot key.

Defined results: vectors that are null, have another number of components than dims, or hold a null, non-finite or too large
component (integers beyond 2 ** 26, whose squared distances no long holds) are dropped; fewer vectors than centroids make fewer
centroids; rows with one vec_id are vectors of their own, and start centroids in order of their components; a null vec_id never
starts a centroid while others are left; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, map_arrow, stage
from .integer_vectors import integers, lists, rows_of, squared_distances

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
MARGIN = 1e-9
#: Columns of a pass: value is a vector's distance (kind 0, last pass) or a task's count of a centroid (kind 1).
NAMES = ["kind", "vec_id", "x", "near", "upper", "lower", "cluster", "value", "sums", "deepest", "scans"]
STATE = "kind int, vec_id {id}, x array<int>, near array<int>, upper double, lower array<double>, cluster int, value long, sums array<long>, deepest int, scans long"


@dataclass
class Clusters:
    """rows: vec_id, cluster, distance. centroids: integers, as the last assignment saw them. scans: whole rescans, by pass."""

    rows: DataFrame
    centroids: np.ndarray
    scans: list[int]


@dataclass
class State:
    """Vectors with their bounds: near holds the own centroid, then the listed ones; lower theirs and, last, the remainder's."""

    x: np.ndarray
    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def ordered(distance: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Each row's places in order of distance, ties by name."""
    by_name = np.argsort(names, axis=1, kind="stable")
    again = np.argsort(np.take_along_axis(distance, by_name, 1), axis=1, kind="stable")
    return np.take_along_axis(by_name, again, 1)


def scan(x: np.ndarray, centroids: np.ndarray, tracked: int) -> State:
    """The state of vectors by exact distances to all centroids."""
    k = len(centroids)
    found = squared_distances(x, centroids)
    order = np.argsort(found, axis=1, kind="stable")
    far = np.sqrt(np.take_along_axis(found, order, 1).astype(np.float64))
    rest = far[:, tracked + 1 : tracked + 2] if tracked + 1 < k else np.full((len(x), 1), np.inf)
    return State(x, order[:, : tracked + 1].astype(np.int32), far[:, 0], np.hstack([far[:, 1 : tracked + 1], rest]))


def exact(x: np.ndarray, near: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to its own list of centroids."""
    out = np.empty(near.shape, np.int64)
    for j in range(near.shape[1]):
        step = x.astype(np.int64) - centroids[near[:, j]]
        out[:, j] = np.einsum("ij,ij->i", step, step)
    return out


def needed(state: State) -> np.ndarray:
    """How many ranks cannot be certified to be farther than the upper bound; one more than are listed: the remainder, too."""
    floor = np.minimum.accumulate(state.lower[:, ::-1], axis=1)[:, ::-1]
    return (floor * (1 - MARGIN) <= state.upper[:, None] * (1 + MARGIN) + MARGIN).sum(axis=1)


def reassign(state: State, centroids: np.ndarray, steps: np.ndarray) -> tuple[int, int]:
    """Move the bounds by the centroids' steps and put right, in place, what they no longer certify. Returns the deepest rank
    that was looked at and the number of whole scans."""
    state.upper += steps[state.near[:, 0]]
    state.lower[:, :-1] -= steps[state.near[:, 1:]]
    state.lower[:, -1] -= steps.max(initial=0.0)
    np.maximum(state.lower, 0, out=state.lower)
    open_ = np.flatnonzero(needed(state))
    if not len(open_):
        return 0, 0
    state.upper[open_] = np.sqrt(exact(state.x[open_], state.near[open_, :1], centroids)[:, 0].astype(np.float64))
    part = State(state.x[open_], state.near[open_], state.upper[open_], state.lower[open_])
    depth, listed = needed(part), state.near.shape[1] - 1
    for d in np.unique(depth[(depth > 0) & (depth <= listed)]).tolist():
        at = open_[depth == d]
        names = state.near[at, : d + 1]
        found = exact(state.x[at], names, centroids)
        order = ordered(found, names)
        far = np.sqrt(np.take_along_axis(found, order, 1).astype(np.float64))
        state.near[at, : d + 1] = np.take_along_axis(names, order, 1)
        state.upper[at] = far[:, 0]
        state.lower[at, :d] = far[:, 1:]
    whole = open_[depth > listed]
    if len(whole):
        new = scan(state.x[whole], centroids, listed)
        state.near[whole], state.upper[whole], state.lower[whole] = new.near, new.upper, new.lower
    return int(depth.max(initial=0)), len(whole)


def narrowed(state: State, tracked: int) -> State:
    """The state with fewer ranks listed: the bounds of those dropped join the remainder."""
    if tracked >= state.near.shape[1] - 1:
        return state
    rest = state.lower[:, tracked:].min(axis=1, keepdims=True)
    return State(state.x, state.near[:, : tracked + 1].copy(), state.upper, np.hstack([state.lower[:, :tracked], rest]))


def summed(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums of vectors by cluster."""
    order = np.argsort(cluster, kind="stable")
    n, sums = np.bincount(cluster, minlength=k), np.zeros((k, x.shape[1]), np.int64)
    used = np.flatnonzero(n)
    if len(used):
        sums[used] = np.add.reduceat(x[order].astype(np.int64), (np.cumsum(n) - n)[used], axis=0)
    return n, sums


def pass_over(rows: DataFrame, schema: str, centroids: np.ndarray, steps: np.ndarray | None, listed: int, tracked: int, last: bool) -> DataFrame:
    """One assignment: the new state (kind 0; in the last pass upper is the exact distance's root), and each task's sums (kind 1)."""
    k, dims = centroids.shape

    def run(batches):
        n, sums, deepest, scans = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column(1), dims)
            if steps is None:
                state, scans = scan(x, centroids, tracked), scans + len(x)
            else:
                state = State(x, rows_of(batch.column(2), listed + 1).copy(), batch.column(3).to_numpy().copy(), rows_of(batch.column(4), listed + 1).copy())
                deep, whole = reassign(state, centroids, steps)
                deepest, scans, state = max(deepest, deep), scans + whole, narrowed(state, tracked)
            own = state.near[:, 0]
            more, plus = summed(x, own, k)
            n += more
            sums += plus
            none = lambda kind: pa.nulls(len(x), kind)  # noqa: B023,E731
            distance = pa.array(exact(x, state.near[:, :1], centroids)[:, 0]) if last else none(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), batch.column(0), batch.column(1), lists(state.near, pa.int32()), pa.array(state.upper), lists(state.lower, pa.float64()), pa.array(own), distance, none(pa.list_(pa.int64())), none(pa.int32()), none(pa.int64())], names=NAMES)
            kind = batch.column(0).type
        if n.any():
            none = lambda kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), none(kind), none(pa.list_(pa.int32())), none(pa.list_(pa.int32())), none(pa.float64()), none(pa.list_(pa.float64())), pa.array(np.arange(k, dtype=np.int32)), pa.array(n), lists(sums, pa.int64()), pa.array(np.full(k, deepest, np.int32)), pa.array(np.where(np.arange(k) == 0, scans, 0))], names=NAMES)

    return map_arrow(rows, run, schema)


def gathered(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The next centroids, the deepest rank and the whole scans of a pass, from its tasks' sums."""
    dims = centroids.shape[1]
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    found = state.where("kind = 1").groupBy("cluster").agg(F.sum("value").alias("n"), F.max("deepest").alias("deepest"), F.sum("scans").alias("scans"), *sums).collect()
    out = centroids.copy()
    for r in found:
        if r["n"]:
            out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out, max((r["deepest"] for r in found), default=0), sum(r["scans"] for r in found)


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, tracked: int | None = None) -> Clusters:
    """Centroids start as the kept vectors of the smallest sha256 of `seed:vec_id`; after the rounds, vectors are assigned once more."""
    whole, x = integers(F.col(vector), scale, dims)
    kept = vectors.where(whole).select(F.col(vec_id).alias("vec_id"), x.alias("x"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("x", order.alias("place")).orderBy(F.asc_nulls_last("place"), "x").limit(clusters).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), dims)
    if not first:
        return Clusters(kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, [])
    k, schema = len(first), STATE.format(id=kept.schema["vec_id"].dataType.simpleString())
    listed = tracked = min(k - 1, max(2, -(-k // 4)) if tracked is None else tracked)
    steps, state, scans = None, None, []
    for r in range(rounds + 1):
        source = kept if state is None else state.where("kind = 0").select("vec_id", "x", "near", "upper", "lower")
        new = stage(pass_over(source, schema, centroids, steps, listed, tracked, r == rounds), "bounds")
        if state is not None:
            drop(state)
        state, listed = new, tracked
        moved, deepest, whole_scans = gathered(state, centroids)
        scans.append(whole_scans)
        if r < rounds:
            steps = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1))
            centroids = moved
            if r:
                tracked = min(tracked, max(deepest, -(-k // 8), 1))
    return Clusters(state.where("kind = 0").select("vec_id", "cluster", F.col("value").alias("distance")), centroids, scans)


def digest(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Sums by cluster, one row each, pass through the driver."""
    own = {r["cluster"]: int(r["own"]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    every = sum(own.values())
    told = [(c, own.get(c, 0), every, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(found.centroids.tolist())]
    table = found.rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
