"""Tables in buckets, and landed pages that name one another."""

import json

from pyspark.sql import functions as F

from strandgraph.operators import graph
from strandgraph.operators.layout import GraphLayout
from strandgraph.sources import paging, payloads, star

from .oracle import DATA
from .test_sources import study


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_named_edges_of_buckets_shuffle_nothing(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        types, kinds = ["associated_with", "inhibits"], ["disease", "target", "drug"]
        layout = GraphLayout.build(star.entities(spark, DATA, kinds), star.edges(spark, DATA, types))
        found = layout.decorated(0.02)
        text = plan(found)
        assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text
        expected = graph.decorated(graph.at_least(star.edges(spark, DATA, types), 0.02), star.entities(spark, DATA, kinds))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
        frontier = layout.entities.where("kind = 'drug'").select(F.col("id").alias("src_id"))
        assert "Exchange" not in plan(layout.edges.join(frontier, "src_id", "left_semi"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        layout.drop()
    assert not spark.catalog.tableExists(f"{layout.name}_edge")


def test_a_least_score_reaches_the_scan(spark):
    text = plan(star.edges(spark, DATA, ["manufactured_by"], 0.05))
    assert "GreaterThanOrEqual(l_discount,0.05)" in text


def landed(tmp_path, query, **pages):
    folder = tmp_path / query
    folder.mkdir()
    for name, body in pages.items():
        (folder / f"{name.lstrip('_')}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def page(*names, token=None, **more):
    return {"studies": [study(n, f"title {n}", "Acme", [], []) for n in names]} | ({"nextPageToken": token} if token else {}) | more


def test_token_chains_are_followed_to_their_ends(spark, tmp_path):
    landed(tmp_path, "whole", first=page("N1", "N2", token="t1"), t1=page("N3", token="t2"), t2=page("N4"), stray=page("N9"))
    landed(tmp_path, "empty", first=page("N5", token="x"), x=page(token="y"), y=page("N9"))
    landed(tmp_path, "error", first=page("N6", token="x"), x=page("N7", token="y", errors=[{"message": "bad"}]), y=page("N9"))
    landed(tmp_path, "torn", first=page("N8", token="x"), x='{"studies": [{"protocol')
    landed(tmp_path, "loop", first=page("N10", token="x"), x=page("N11", token="first"))
    landed(tmp_path, "missing", first=page("N12", token="gone"))
    landed(tmp_path, "outside", first=page("N13", token="../whole/t1"))
    landed(tmp_path, "nothing", second=page("N9"))
    found = paging.pages(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 7
    ends = {r["query"]: (r["page"], r["ended"]) for r in found.where("ended IS NOT NULL").collect()}
    assert ends == {"whole": (2, "last"), "empty": (1, "empty"), "error": (1, "error"), "torn": (1, "error"), "loop": (1, "loop"), "missing": (0, "missing"), "outside": (0, "missing")}
    assert {e for _, e in ends.values()} == set(paging.ENDS)
    rows = payloads.paged_studies(spark, str(tmp_path)).orderBy("nct_id").collect()
    assert sorted(r["nct_id"] for r in rows) == sorted(["N1", "N2", "N3", "N4", "N5", "N6", "N7", "N8", "N10", "N11", "N12", "N13"])
    assert {r["nct_id"]: (r["batch_seq"]["page"], r["batch_seq"]["pos"]) for r in rows}["N3"] == (1, 0)


def test_numbered_association_pages(spark, tmp_path):
    rows = lambda *ids: {"data": {"disease": {"associatedTargets": {"rows": [{"target": {"id": i, "approvedSymbol": "S", "approvedName": i}, "score": 0.5} for i in ids]}}}}
    landed(tmp_path, "D1", first=rows("E1", "E2"), _1=rows("E3"), _2=rows(), _3=rows("E9"))
    landed(tmp_path, "D2", first={"data": None})
    assert sorted(r["canonical_id"] for r in payloads.paged_associations(spark, str(tmp_path)).where("mesh_id = 'D1'").collect()) == [f"OPENTARGETS:E{i}" for i in (1, 2, 3)]
    assert [(r["page"], r["ended"]) for r in paging.pages(spark, str(tmp_path)).where("ended IS NOT NULL").orderBy("query").collect()] == [(2, "empty"), (0, "empty")]


def test_an_empty_landing(spark, tmp_path):
    assert paging.pages(spark, str(tmp_path)).collect() == []
