import pytest
from pyspark.sql import functions as F

from strandgraph import schemas
from strandgraph.operators import evidence, graph, search, stats, store
from strandgraph.plans import catalog, pipeline
from strandgraph.sources import landing, star

from .oracle import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_and_insert_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, seq int")
    once = store.upsert(old, new, ["k"], "seq")
    twice = store.upsert(once, new, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    first = store.insert_if_absent(old, new, ["k"], "seq")
    assert sorted(map(tuple, first.collect())) == [(1, "a"), (2, "b"), (3, "z")]


def test_store_publishes_versions_and_checks_keys(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    assert "entity" in s.missing() and s.read("entity").count() == 0
    rows = spark.createDataFrame([("drug", "D1", "one"), ("target", "T1", "two")], "kind string, canonical_id string, name string")
    s.publish("entity", rows.withColumn("id", store.entity_id(F.col("kind"), F.col("canonical_id"))))
    assert s.exists("entity") and s.read("entity").count() == 2
    assert "PartitionFilters: [isnotnull(kind" in plan(s.read("entity").where("kind = 'drug'"))
    with pytest.raises(store.ConstraintError):
        s.publish("entity", rows.unionByName(rows))
    assert s.read("entity").count() == 2


def test_merge_props(spark):
    old = spark.createDataFrame([(1, '{"a":"1"}', "x"), (2, None, "y"), (3, '{"a":"3"}', "z")], "k long, props string, v string")
    new = spark.createDataFrame([(1, '{"a":null,"b":"2"}'), (2, '{"c":"4"}')], "k long, props string")
    found = {r["k"]: r["props"] for r in store.merge_props(old, new, ["k"]).collect()}
    assert found == {1: '{"a":null,"b":"2"}', 2: '{"c":"4"}', 3: '{"a":"3"}'}


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1,), (9,), (None,)], "p long")
    parent = spark.createDataFrame([(1,)], "id long")
    assert [r["p"] for r in store.orphans(child, parent, ["p"], ["id"]).collect()] == [9]
    with pytest.raises(store.ConstraintError):
        store.check_foreign(child, parent, ["p"], ["id"])


def test_license_gate(spark):
    licenses = schemas.license_allowlist(spark)
    assert evidence.seed_is_sane(licenses)
    good = spark.createDataFrame([("e1", "MIT")], "evidence_id string, license string")
    assert evidence.gate(good, licenses).count() == 1
    for bad in ("PROPRIETARY", "unknown", None):
        batch = good.unionByName(spark.createDataFrame([("e2", bad)], "evidence_id string, license string"))
        with pytest.raises(store.ConstraintError):
            evidence.gate(batch, licenses)
        assert evidence.violations(batch, licenses).count() == 1


def test_validity_and_expiry(spark):
    rows = spark.sql("SELECT DATE'2024-01-01' AS effective_from, DATE'2024-02-01' AS effective_to UNION ALL SELECT DATE'2024-01-15', NULL")
    counts = [evidence.as_of(rows, F.lit(d).cast("date")).count() for d in ("2023-12-31", "2024-01-01", "2024-01-31", "2024-02-01", "2030-01-01")]
    assert counts == [0, 1, 2, 1, 1]
    cache = spark.sql("SELECT 1 AS k, TIMESTAMP'2024-01-01 00:00:00' AS expires_at")
    assert evidence.live(cache, F.lit("2024-01-01 00:00:00").cast("timestamp")).count() == 1
    assert evidence.live(cache, F.lit("2024-01-01 00:00:01").cast("timestamp")).count() == 0


def test_degree_counts_self_loop_once(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "src_id long, dst_id long")
    assert {r["id"]: r["degree"] for r in graph.degrees(edges).collect()} == {1: 3, 2: 1, 3: 1}


def test_descendants_are_bounded_by_dots(spark):
    tree = spark.createDataFrame([("C01",), ("C01.2",), ("C010",)], "tree_number string")
    assert sorted(r[0] for r in graph.descendants(tree, "C01").collect()) == ["C01", "C01.2"]


def test_search_cases(spark):
    e = spark.createDataFrame([(1, "drug", "a_b"), (2, "drug", "axb"), (3, "target", "100%"), (4, "target", "Ab")], "id long, kind string, name string")
    ids = lambda q, kind=None: [r["id"] for r in search.search(e, q, kind).collect()]
    assert ids("  ") == [] and ids("a_b") == [1, 2] and ids("a\\_b") == [1] and ids("AB") == [4] and ids("\\b") == [1, 2, 4]
    assert ids("0\\") == [3] and ids("b", "drug") == [1, 2]


def test_filters_of_lists(spark):
    rows = spark.createDataFrame([(1, ["D1", "D2"]), (2, ["D3"])], "k long, mesh_ids array<string>")
    assert [r["k"] for r in search.matching(rows, ["D2"]).collect()] == [1]
    assert search.matching(rows.drop("mesh_ids"), ["D2"]).count() == 2
    assert search.list_entities(spark.range(500).withColumn("kind", F.lit("x")), "x", 999).count() == 200


def test_plans(spark):
    top = plan(catalog.top_k_per_group(spark, DATA))
    assert "WindowGroupLimit" in top
    scored = plan(catalog.graph_edges_min_score(spark, DATA))
    assert "CartesianProduct" not in scored and "BroadcastNestedLoopJoin" not in scored and "Python" not in scored
    one = plan(star.entities(spark, DATA, ["drug"]))
    assert one.count("FileScan") == 1 and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in one


def test_health_and_stats(spark):
    assert stats.health(spark)["status"] == "healthy"
    assert stats.stats(star.entities(spark, DATA), star.edges(spark, DATA, ["associated_with"]))["edges"] > 0


def test_tables_are_created_in_order_once(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.create(["edge", "entity"]) == ["entity", "edge"]
    assert s.create(["entity", "alias"]) == ["alias"] and s.read("alias").count() == 0
    with pytest.raises(KeyError):
        s.create(["nothing"])


def test_demo_graph(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    for _ in range(2):
        found = pipeline.run(s, {}, ["demo"], F.lit("2024-01-01").cast("timestamp"))
    kinds = {r["type"]: r["count"] for r in s.read("edge").groupBy("type").count().collect()}
    assert found["entity"] == 22 and kinds == {"inhibits": 7, "associated_with": 6}
    assert s.read("entity").select("updated_at").distinct().first()[0].year == 2024


def test_token_search(spark):
    names = spark.createDataFrame([(1, "Alpha, beta-Gamma"), (2, "alpha alpha"), (3, None), (4, "")], "id long, name string")
    index = search.token_index(names)
    assert sorted(map(tuple, index.collect())) == [("alpha", 1), ("alpha", 2), ("beta", 1), ("gamma", 1)]
    assert [r["id"] for r in search.search_tokens(index, "BETA alpha").collect()] == [1]
    assert search.search_tokens(index, " ,").count() == 0


def test_cached_download(tmp_path):
    (tmp_path / "a").write_text("one")
    path, url = str(tmp_path / "x" / "copy"), f"file://{tmp_path}/a"
    assert landing.cached(url, path) == path and open(path).read() == "one"
    (tmp_path / "a").write_text("two")
    assert open(landing.cached(url, path)).read() == "one"
    open(path, "w").close()
    assert open(landing.cached(url, path)).read() == "two"
