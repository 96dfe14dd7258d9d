"""op8 on texts of one template: candidates grow with the texts, not with their pairs; and links among them are found."""

import random

import pytest

from strandgraph.llm import jaccard_join
from strandgraph.llm.common import stage

from . import brute


def template_pages(n, own=2, shared=10):
    head = " ".join(f"shared{i}" for i in range(shared))
    return [(i, " ".join(f"own{i}x{j}" for j in range(own)) + " " + head) for i in range(n)]


def second_round(spark, rows, monkeypatch):
    counted = {}

    def kept(post, labels, classes, real=jaccard_join.crossing):
        pairs = stage(real(post, labels, classes), "counted")
        counted["pairs"] = pairs.count()
        return pairs

    monkeypatch.setattr(jaccard_join, "crossing", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard_join.digest(jaccard_join.near_duplicates(docs)).collect()
    return counted["pairs"], found


@pytest.mark.parametrize("n", [1000, 4000])
def test_pages_of_one_template_are_no_candidates(spark, monkeypatch, n):
    pairs, found = second_round(spark, template_pages(n), monkeypatch)
    assert pairs <= n // 100
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 8 for r in found)


@pytest.mark.parametrize(("small", "seed"), [(32, 1), (2, 2), (2, 3), (0, 4)])
def test_templates_with_links_equal_brute_force(spark, monkeypatch, small, seed):
    """Texts around the bound: one template, none to four words changed, of several lengths, with exact copies."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "QUERY_BLOCK", 4)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = base[: rng.choice([8, 12, 20, 40, 44, 48, 60])]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"own{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard_join.digest(jaccard_join.near_duplicates(docs)).collect()
    assert sorted(map(tuple, found)) == sorted(brute.near_duplicates(rows))
