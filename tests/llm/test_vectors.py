"""op11 and op13 against plain loops over Python integers, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from strandgraph.llm import distinct_codes, drake_kmeans
from strandgraph.llm.integer_vectors import squared_distances

SCHEMA = "vec_id long, embedding array<float>, label int, code string, `row` string, x string"


def made(seed, n, dims, spread=0.3, centres=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (centres, dims))
    return (base[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dims))).astype(np.float32)


@pytest.fixture(scope="module")
def rows():
    """Vectors of 8 components with copies, ties, and rows that are no vectors of 8 finite components."""
    x = made(1, 150, 8)
    out = [(i, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)]
    out += [(200 + i, out[5][1], 1) for i in range(60)] + [out[7], out[7], (None, out[9][1], 2), (None, [0.0] * 8, None)]
    bad = [None, [], [0.0] * 7, [0.0] * 9, [0.0] * 7 + [None], [0.0] * 7 + [math.nan], [0.0] * 7 + [math.inf], [0.0] * 7 + [3e38]]
    return out + [(500 + i, v, 1) for i, v in enumerate(bad)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)


def kept(rows, scale, dims=8):
    good = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(v is not None and math.isfinite(v) and abs(v * scale) < 1 << 26 for v in r[1])]
    return [(r[0], [math.floor(scale * v) for v in r[1]], r[2]) for r in good]


def plain_codes(rows, parts, entries, rounds, width):
    data = kept(rows, 256)
    first = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    best = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = {}
            for r in data:
                members.setdefault(best(cut(r[1], p), p)[1], []).append(cut(r[1], p))
            new.append([[sum(c) // len(members[i]) for c in zip(*members[i])] if i in members else e for i, e in enumerate(books[p])])
        books = new
    told = [[best(cut(r[1], p), p) for p in range(parts)] for r in data]
    error = [sum(d for d, _ in t) for t in told]
    by = {}
    for r, e in zip(data, error):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{i:02x}" for _, i in t), e, by[r[2]], sha) for r, t, e in zip(data, told, error))


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 6, 2), (2, 500, 1), (8, 3, 0)])
def test_codes_equal_plain_loops(spark, rows, table, parts, entries, rounds):
    found = distinct_codes.digest(distinct_codes.encode(table, dims=8, parts=parts, entries=entries, rounds=rounds))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == plain_codes(rows, parts, entries, rounds, 8 // parts)


def test_codes_of_no_vectors(spark, table):
    for part in (table.limit(0), table.where("vec_id >= 500")):
        assert distinct_codes.digest(distinct_codes.encode(part, dims=8, parts=4)).collect() == []
    with pytest.raises(ValueError):
        distinct_codes.encode(table, dims=8, parts=3)


def test_equal_parts_are_one_weighted_row(spark, table):
    """The rounds run over distinct parts: the table of parts holds each once, however many vectors share it."""
    from pyspark.sql import functions as F

    from strandgraph.llm.integer_vectors import integers, split_join

    whole, x = integers(F.col("embedding"), 256, 8)
    parts = table.where(whole).select(F.slice(x, 1, 4).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    assert parts.agg(F.max("n")).first()[0] >= 61
    rows = spark.createDataFrame([(None,)] * 2000 + [(i,) for i in range(3000)], "k int")
    sums = rows.groupBy("k").agg(F.count("*").alias("n"), F.lit("v").alias("value"))
    assert split_join(rows, sums, ["k"], "n", 5000).where("value = 'v'").count() == 5000


def plain_clusters(rows, clusters, rounds, dims=8):
    data = kept(rows, 1024, dims)
    start = sorted(data, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [r[1] for r in start[:clusters]]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for r in data:
            members.setdefault(best(r[1])[1], []).append(r[1])
        centroids = [[sum(c) // len(members[i]) for c in zip(*members[i])] if i in members else c0 for i, c0 in enumerate(centroids)]
    told = [best(r[1]) for r in data]
    own, sha = {}, [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    for d, c in told:
        own[c] = own.get(c, 0) + d
    return sorted((str(r[0]), c, d, own[c], sum(own.values()), sha[c]) for r, (d, c) in zip(data, told))


@pytest.mark.parametrize(("clusters", "rounds", "tracked"), [(8, 10, None), (1, 2, None), (2, 3, None), (40, 6, 3), (40, 4, 39), (500, 2, 5), (8, 0, None)])
def test_clusters_equal_plain_loops(spark, rows, table, clusters, rounds, tracked):
    found = drake_kmeans.cluster(table, dims=8, clusters=clusters, rounds=rounds, tracked=tracked)
    assert sorted((str(r[0]), *r[1:]) for r in drake_kmeans.digest(found).collect()) == plain_clusters(rows, clusters, rounds)


def test_clusters_of_no_vectors(spark, table):
    for part in (table.limit(0), table.where("vec_id >= 500")):
        assert drake_kmeans.digest(drake_kmeans.cluster(part, dims=8)).collect() == []


def test_ties_go_to_the_smaller_centroid(spark):
    """A grid on which many vectors are equally far from several centroids."""
    grid = [(i, [float(a), float(b), 0.0, 0.0], 0) for i, (a, b) in enumerate((a, b) for a in range(-6, 7) for b in range(-6, 7))]
    table = spark.createDataFrame(grid, "vec_id long, embedding array<double>, label int")
    found = drake_kmeans.cluster(table, dims=4, clusters=9, rounds=7)
    assert sorted((str(r[0]), *r[1:]) for r in drake_kmeans.digest(found).collect()) == plain_clusters(grid, 9, 7, 4)


def test_bounds_save_scans_and_hold(spark):
    x = made(5, 3000, 16, 0.2, 20)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = drake_kmeans.cluster(table, dims=16, clusters=32, rounds=8)
    assert found.scans[0] == 3000 and sum(found.scans[1:]) < 8 * 3000 * 0.2
    whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    told = squared_distances(whole, found.centroids)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in found.rows.collect()} == {i: (int(d.argmin()), int(d.min())) for i, d in enumerate(told)}


def test_bounds_never_exceed_true_distances():
    rng = np.random.default_rng(9)
    x, centroids = rng.integers(-300, 300, (400, 6)), rng.integers(-300, 300, (12, 6))
    state = drake_kmeans.scan(x, centroids, 4)
    for _ in range(12):
        new = centroids + rng.integers(-25, 26, centroids.shape)
        steps = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(float))
        drake_kmeans.reassign(state, new, steps)
        centroids = new
        true = np.sqrt(squared_distances(x, centroids).astype(float))
        assert (state.near[:, 0] == true.argmin(axis=1)).all()
        assert (state.upper + 1e-6 >= true[np.arange(400), state.near[:, 0]]).all()
        for j in range(4):
            assert (state.lower[:, j] <= true[np.arange(400), state.near[:, j + 1]] + 1e-6).all()
        np.put_along_axis(true, state.near.astype(np.int64), np.inf, axis=1)
        assert (state.lower[:, -1] <= true.min(axis=1) + 1e-6).all()


def test_distances_are_exact_for_large_integers():
    rng = random.Random(3)
    x = [[rng.randrange(-(1 << 26) + 1, 1 << 26) for _ in range(64)] for _ in range(5)]
    y = [[rng.randrange(-(1 << 26) + 1, 1 << 26) for _ in range(64)] for _ in range(3)]
    assert squared_distances(np.array(x), np.array(y)).tolist() == [[sum((a - b) ** 2 for a, b in zip(u, v)) for v in y] for u in x]
