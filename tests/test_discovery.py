"""Tagging, trigram search and the vector index against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.operators import search as S
from strandgraph.operators import tagging as T
from strandgraph.operators import trigrams as G
from strandgraph.operators import vector_index as V
from strandgraph.sources import star

from .oracle import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_mentions(docs, labels):
    known = {}
    for label, key in labels:
        phrase = " ".join(split(label))
        if phrase:
            known[phrase] = min(key, known.get(phrase, key))
    most, out = max((p.count(" ") + 1 for p in known), default=0), []
    for doc, text in {(d, t) for d, t in docs}:
        w, i = split(text), 0
        while i < len(w):
            n = next((n for n in range(min(most, len(w) - i), 0, -1) if " ".join(w[i : i + n]) in known), 0)
            if n:
                phrase = " ".join(w[i : i + n])
                out.append((str(doc), i, n, phrase, known[phrase]))
            i += n or 1
    return sorted(out)


@pytest.mark.parametrize("few", [100_000, 0])
def test_mentions_equal_a_reader_who_takes_the_longest(spark, few):
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "d", "É", "x1"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, ".,;"), (63, "A, B! c-d"), docs[5], docs[5], (5, "a b c"), (None, "a b"), (64, "a b " * 3000)]
    labels = [("a b", 9), ("A-B", 4), ("a b c", 5), ("b c d é", 6), ("d", 7), ("x1 a", 8), ("b", 3), ("  ", 1), (None, 2), ("zz", 0)]
    found = T.mentions(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "label string, id long"), few=few)
    assert found.columns == ["doc_id", "start", "size", "phrase", "id"]
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == plain_mentions(docs, labels)
    assert "BroadcastHashJoin" in plan(found) or not few


def test_mentions_without_labels_or_documents(spark):
    docs, labels = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("a", 1)], "label string, id long")
    assert T.mentions(docs, labels.limit(0)).collect() == [] and T.mentions(docs.limit(0), labels).collect() == []
    assert T.mentions(docs, spark.createDataFrame([("--", 1)], "label string, id long")).columns == ["doc_id", "start", "size", "phrase", "id"]


def test_gate_and_shadow_labels(spark):
    docs = spark.createDataFrame([(1, "We met Acme Bio today."), (2, "New Pharma Co and New Pharma Co"), (3, "at New Pharma Co we"), (4, "nothing"), (5, None), (6, "about Acme Bio and New Pharma Co"), (7, "Old Name")], "doc_id long, text string")
    labels = spark.createDataFrame([("acme bio", 10), ("old name", 11)], "label string, id long")
    found = T.mentions(docs, labels)
    kept, rejected = T.gate(docs, found)
    assert sorted(r[0] for r in kept.collect()) == [1, 6, 7] and sorted(r[0] for r in rejected.collect()) == [2, 3, 4, 5]
    assert [tuple(r) for r in T.linked(found).orderBy("doc_id").collect()] == [(1, 10, 1, 2), (6, 10, 1, 1), (7, 11, 1, 0)]
    assert [tuple(r) for r in T.shadows(rejected, labels, 2).collect()] == [("new pharma co", 2)]
    assert T.shadows(rejected, spark.createDataFrame([("New-Pharma Co", 1)], "label string, id long"), 1).collect() == []


NAMES = ["Alpha", "alpha beta", "a%b", "a_b", "axb", "ab", "b", "", None, "100%", "Étude", "ALPHABET", "back\\slash", "x", "aaa", "aaaa"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, "drug" if i % 3 else "target", n) for i, n in enumerate(NAMES)], "id long, kind string, name string")


def test_trigram_search_equals_the_scan(names):
    index = G.TrigramIndex.build(names)
    asked = ["alpha", "LPH", "a", "b", "ab", "a_b", "a\\_b", "a%b", "a\\%b", "%", "_", "__", "0\\", "é", "tude", "aaa", "aaaa", "\\b", "a%a", "ha b", "slash", "nothing", "l%h%t", "  "]
    for q in asked:
        for kind in (None, "drug"):
            assert [r["id"] for r in G.search(index, names, q, kind).collect()] == [r["id"] for r in S.search(names, q, kind).collect()], q
    assert len(G.search(index, names, "a", limit=3).collect()) == 3


def test_trigram_search_reads_only_the_postings_asked_for(spark, names):
    index = G.TrigramIndex.build(names)
    found = plan(index.candidates("alpha"))
    assert "PartitionFilters: [" in found and "lead" in found.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(gram, [alp,lph,pha])" in found
    assert "StringStartsWith(gram,ph)" in plan(index.candidates("ph"))
    assert index.candidates("%") is None


def test_literal_parts_and_runs():
    assert G.literal_parts("Ab%c_d") == ["ab", "c", "d"] and G.literal_parts("a\\%B") == ["a%b"] and G.literal_parts("x\\") == ["x%"] and G.literal_parts("%_") == []
    assert G.wanted("abcd%b%zz") == (["abc", "bcd"], ["zz"])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    x = (rng.normal(0, 1, (12, 16))[rng.integers(0, 12, 900)] + rng.normal(0, 0.6, (900, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # copies: more of them than neighbours asked for
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [])]
    return rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)


def plain_neighbours(rows, asked, k):
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    keys = [i for i, _ in rows]
    out = {}
    for q in asked:
        sim = np.round(x @ x[keys.index(q)], 6)
        out[q] = [(key, float(s)) for s, key in sorted((-s, key) for s, key in zip(sim, keys) if key != q)[:k]]
    return out


def told(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["place"])):
        out.setdefault(r["query"], []).append((r["key"], -r["similarity"]))
    return out


def test_exact_search_equals_comparing_all(vectors, monkeypatch):
    rows, table = vectors
    asked = [i for i, _ in rows if i % 20 == 0]
    expected = plain_neighbours(rows, asked, 10)
    queries = table.where("vec_id % 20 = 0")
    found = told(V.VectorIndex.build(table).search(queries, 10, probes=2))
    assert found == expected, [(found[q], expected[q]) for q in expected if found.get(q) != expected[q]][:1]
    monkeypatch.setattr(V, "ROW_BLOCK", 50)  # cells in blocks of rows and of queries
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    monkeypatch.setattr(V, "STEP", 7)
    assert told(V.VectorIndex.build(table, cells=5).search(queries, 10, probes=1)) == expected


def test_recall_of_a_few_cells(spark):
    """The stated queries against brute force, with as many cells as an exact search of other queries asks for."""
    table = spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.select("vec_id", "embedding").collect()]
    expected = plain_neighbours(rows, [i for i, _ in rows if i % 20 == 0], 10)
    index = V.VectorIndex.build(table)
    probes = index.probes_for(table.where("vec_id % 20 = 10"), 10, 0.95)
    assert 1 < probes < len(index.centroids)
    found = told(index.search(table.where("vec_id % 20 = 0"), 10, probes=probes, exact=False))
    hits = sum(len({k for k, _ in found[q]} & {k for k, _ in expected[q]}) for q in expected)
    print("cells", len(index.centroids), "probes", probes, "recall", hits / (10 * len(expected)))
    assert hits >= 0.9 * 10 * len(expected)


def test_index_of_no_vectors(spark, vectors):
    _, table = vectors
    index = V.VectorIndex.build(table.where("vec_id >= 2000"))
    assert index.search(table, 5).collect() == []
    assert V.VectorIndex.build(table).search(table.where("vec_id >= 2000"), 5).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert V.VectorIndex.build(one).search(one, 3).collect() == []


def test_topics_are_found_in_documents(spark):
    assert star.topics(spark, DATA).where(F.col("label").contains("  ")).count() == 0
