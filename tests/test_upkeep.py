"""The store's writes, cascades, the feed of watched entities, and views of all roots."""

import json

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import graph, store
from strandgraph.schemas import Link
from strandgraph.streaming import ingest

ENTITY = "kind string, canonical_id string, name string, props string, mesh_ui string"


@pytest.fixture
def held(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/s", F.lit("2024-01-10").cast("timestamp"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_upsert_keeps_what_the_batch_lacks(spark, held):
    held.publish("entity", spark.createDataFrame([("drug", "a", "Old", '{"x":1}', "D1"), ("drug", "b", "B", None, None)], ENTITY))
    batch = spark.createDataFrame([("drug", "a", "First", 1), ("drug", "a", "New", 2), ("drug", "c", "C", 1)], "kind string, canonical_id string, name string, seq int")
    for _ in range(2):
        held.upsert("entity", batch, "seq", {"created_at": held.now})
    assert rows(held.read("entity"), "canonical_id", "name", F.coalesce("props", F.lit("-")), F.coalesce("mesh_ui", F.lit("-"))) == [("a", "New", '{"x":1}', "D1"), ("b", "B", "-", "-"), ("c", "C", "-", "-")]
    assert [r["canonical_id"] for r in held.read("entity").where("created_at IS NOT NULL").collect()] == ["c"]
    nulls = batch.where("seq = 2").withColumn("props", F.lit(None).cast("string"))
    held.upsert("entity", nulls, "seq")
    assert rows(held.read("entity").where("canonical_id = 'a'"), F.coalesce("props", F.lit("-")), "mesh_ui") == [("-", "D1")]


def test_upsert_with_null_keys_and_new_columns(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "x", 1), (1, "y", 1)], "k long, w string, seq int")
    assert sorted(map(str, store.upsert(old, new, ["k"], "seq").collect())) == ["Row(k=1, v='a', w='y')", "Row(k=2, v=None, w='x')", "Row(k=None, v='n', w=None)"]


def test_a_write_that_stops_leaves_the_tables(spark, held, monkeypatch, tmp_path):
    one = spark.createDataFrame([("L1", True, None)], "license string, is_commercial_safe boolean, notes string")
    two = spark.createDataFrame([("L2", True, None)], one.schema)
    held.publish("license_allowlist", one)
    with monkeypatch.context() as m:
        m.setattr(store.Store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            held.publish("license_allowlist", two)
    assert rows(held.read("license_allowlist"), "license") == [("L1",)]
    # A commit that was begun and not ended counts for nothing, and its number is passed over.
    (tmp_path / "s" / "_log" / f"{held.last() + 1:020d}.json").write_text('{"tables": {"license_')
    assert rows(held.read("license_allowlist"), "license") == [("L1",)]
    held.insert("license_allowlist", two)
    assert rows(held.read("license_allowlist"), "license") == [("L1",), ("L2",)]
    assert rows(held.read("license_allowlist", at=1), "license") == [("L1",)]
    assert len(held.vacuum()) == 2 and held.vacuum() == []
    assert rows(held.read("license_allowlist"), "license") == [("L1",), ("L2",)]


def test_the_second_of_two_writers_fails(spark, held):
    one = spark.createDataFrame([("L1", True, None)], "license string, is_commercial_safe boolean, notes string")
    after = held.last()
    version = held.write("license_allowlist", one)
    held.publish("license_allowlist", one)
    with pytest.raises(store.Conflict):
        held.commit({"license_allowlist": version}, after)


def test_a_broken_table_of_many_commits_none(spark, held):
    good = spark.createDataFrame([("u", "n")], "ui string, name string")
    with pytest.raises(store.ConstraintError):
        held.publish_all({"mesh_descriptor": good, "mesh_alias": spark.createDataFrame([("u", "x"), ("u", "x")], "ui string, alias string")})
    assert not held.exists("mesh_descriptor") and held.read("mesh_descriptor").count() == 0
    assert held.publish_all({"mesh_descriptor": good, "mesh_alias": good.select("ui", F.col("name").alias("alias"))}) == 1


def filled(spark, held):
    entity = spark.createDataFrame([("drug", "a", 1), ("drug", "b", 2), ("target", "a", 3)], "kind string, canonical_id string, id long")
    edge = spark.createDataFrame([("drug", "a", "target", "a", "inhibits"), ("drug", "b", "target", "a", "inhibits"), ("drug", "b", "drug", "a", "like")], "src_kind string, src_cid string, dst_kind string, dst_cid string, type string")
    assertion = spark.createDataFrame([("s1", 1, 3), ("s2", 2, 3), ("s3", 2, None), ("s4", 3, 1)], "assertion_id string, subject_entity_id long, object_entity_id long")
    bridge = spark.createDataFrame([("s1", "e1"), ("s2", "e1"), ("s3", "e2"), ("s4", "e2")], "assertion_id string, evidence_id string")
    held.publish_all({"entity": entity, "alias": spark.createDataFrame([("drug", "a", "A"), ("target", "a", "T")], "kind string, canonical_id string, alias string"), "edge": edge, "assertion": assertion, "assertion_evidence": bridge})


def test_deletes_go_through_all_levels_in_one_commit(spark, held):
    filled(spark, held)
    before = held.last()
    touched = held.delete("entity", spark.createDataFrame([("drug", "a")], "kind string, canonical_id string"))
    assert held.last() == before + 1 and set(touched) == {"entity", "alias", "edge", "assertion", "assertion_evidence"}
    assert rows(held.read("entity"), "kind", "canonical_id") == [("drug", "b"), ("target", "a")]
    assert rows(held.read("alias"), "alias") == [("T",)]
    assert rows(held.read("edge"), "src_cid", "dst_kind") == [("b", "target")]
    assert rows(held.read("assertion"), "assertion_id") == [("s2",), ("s3",)]
    assert rows(held.read("assertion_evidence"), "assertion_id", "evidence_id") == [("s2", "e1"), ("s3", "e2")]
    assert held.read("assertion_evidence", at=before).count() == 4
    assert held.delete("entity", spark.createDataFrame([("drug", "none")], "kind string, canonical_id string")) and held.read("edge").count() == 1


def test_keys_that_do_not_cascade_stop_a_delete(spark, held):
    held.publish_all({"mesh_descriptor": spark.createDataFrame([("D1", "x"), ("D2", "y")], "ui string, name string"), "mesh_tree": spark.createDataFrame([("D1", "C1"), ("D2", "C2")], "ui string, tree_number string"), "entity": spark.createDataFrame([("disease", "MESH:D1", "D1")], "kind string, canonical_id string, mesh_ui string")})
    with pytest.raises(store.ConstraintError):
        held.delete("mesh_descriptor", spark.createDataFrame([("D1",)], "ui string"))
    assert held.read("mesh_tree").count() == 2
    held.delete("mesh_descriptor", spark.createDataFrame([("D2",)], "ui string"))
    assert rows(held.read("mesh_tree"), "ui") == [("D1",)]


def test_circles_of_keys_are_refused():
    links = [Link("a", ("x",), "b", ("y",)), Link("b", ("x",), "a", ("y",))]
    with pytest.raises(ValueError):
        store.parents_first(links)
    names = store.parents_first(store.FOREIGN_KEYS)
    assert all(names.index(link.parent) < names.index(link.child) for link in store.FOREIGN_KEYS)


def test_a_write_to_the_cache_evicts_all_that_has_expired(spark, held):
    schema = "cache_key string, value_json string, expires string"
    made = lambda *r: spark.createDataFrame(list(r), schema).withColumn("expires_at", F.to_timestamp("expires")).drop("expires")
    held.publish("lookup_cache", made(("old", "1", "2024-01-09"), ("live", "1", "2024-01-10"), ("renewed", "1", "2024-01-01")))
    held.insert("lookup_cache", made(("born expired", "2", "2024-01-09"), ("new", "2", "2024-02-01")))
    assert rows(held.read("lookup_cache"), "cache_key") == [("live",), ("new",)]
    held.upsert("lookup_cache", made(("live", "3", "2024-01-05"), ("renewed", "3", "2024-03-01")).withColumn("seq", F.lit(1)), "seq")
    assert rows(held.read("lookup_cache"), "cache_key", "value_json") == [("new", "2"), ("renewed", "3")]


def event(i, user, minute, kind="view"):
    return {"event_id": i, "user_id": user, "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00", "event_type": kind}


SCHEMA = "event_id long, user_id long, ts timestamp, event_type string"


def test_sessions_of_a_stream_with_late_and_repeated_rows(spark, tmp_path):
    """Late rows within the delay grow and merge sessions, later ones and repeats change nothing, users not watched are left out."""
    watched = spark.createDataFrame([(1,), (2,), (2,)], "user_id long")
    files = [
        [event(1, 1, 0), event(2, 1, 50), event(3, 2, 5, "click"), event(4, 9, 5)],
        [event(5, 1, 25, "error"), event(2, 1, 50), event(6, 2, 100)],  # late, and joins two runs; a repeat
        [event(7, 1, 600)],  # the watermark passes all before
        [event(8, 1, 10), event(9, 2, 605)],  # too late; on time
        [event(10, 9, 1300), event(11, 1, 1300)],
    ]
    landing = tmp_path / "in"
    landing.mkdir()
    for i, lines in enumerate(files):
        (landing / f"{i}.json").write_text("\n".join(map(json.dumps, lines)))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(landing))
        ingest.start_sessions(stream, watched, f"{tmp_path}/out", f"{tmp_path}/cp", gap="30 minutes", delay="2 hours").awaitTermination(180)
    found = sorted((r["user_id"], r["first"].hour * 60 + r["first"].minute, r["last"].hour * 60 + r["last"].minute, r["updates"], r["kinds"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [(1, 0, 50, 3, "error,view"), (1, 600, 600, 1, "view"), (2, 5, 5, 1, "click"), (2, 100, 100, 1, "view"), (2, 605, 605, 1, "view")]
    on_time = [e for part in files for e in part if e["event_id"] not in (8, 11)]
    batch = ingest.watch_sessions(spark.createDataFrame([tuple(e.values()) for e in on_time], "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts")), watched)
    assert sorted((r["user_id"], r["updates"], r["kinds"]) for r in batch.collect()) == sorted((u, n, k) for u, _, _, n, k in found)


def test_feed_counts_of_a_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.json").write_text("\n".join(map(json.dumps, [event(1, 1, 0), event(2, 2, 59), event(3, 1, 61), event(4, 1, 30, "click")])))
    (landing / "b.json").write_text(json.dumps(event(5, 1, 600)))
    for _ in range(2):
        stream = ingest.feed_counts(spark.readStream.schema(SCHEMA).json(str(landing)))
        stream.writeStream.outputMode("complete").format("memory").queryName("feed").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["window"]["start"].hour, r["event_type"], r["n"]) for r in spark.table("feed").collect()) == [(0, "click", 1), (0, "view", 2), (1, "view", 1), (10, "view", 1)]


def test_absorb_takes_new_keys_only(spark):
    old, new = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k long, v string")
    assert rows(ingest.absorb(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c")]


def test_descendants_of_every_descriptor(spark):
    tree = spark.createDataFrame([("a", "C01"), ("b", "C01.1"), ("c", "C01.1.2"), ("c", "C02.9"), ("d", "C02"), ("e", "C010"), ("f", None), ("b", "C02.7")], "ui string, tree_number string")
    found = rows(graph.all_descendants(tree), "ancestor", "ui", "depth")
    assert found == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1), ("c", "c", 0), ("d", "b", 1), ("d", "c", 1), ("d", "d", 0), ("e", "e", 0)]
    text = graph.all_descendants(tree)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_views_of_all_diseases_are_the_views_of_each(spark):
    schema = "type string, src_id long, dst_id long, src_kind string, dst_kind string, score double"
    made = [("associated_with", d, t, "disease", "target", 0.5) for d, t in ((1, 10), (1, 11), (2, 11), (3, 12))] + [("inhibits", p, t, "drug", "target", 0.1) for p, t in ((20, 10), (21, 11), (22, 13))] + [("treats", 23, 1, "drug", "disease", None), ("like", 20, 21, "drug", "drug", None)] + [("manufactured_by", p, c, "drug", "company", None) for p, c in ((20, 30), (21, 30), (22, 31), (23, 31))]
    edges = spark.createDataFrame(made, schema)
    found = graph.all_subgraphs(edges)
    for disease in (1, 2, 3, 4):
        assert rows(found.where(F.col("disease") == disease), "type", "src_id", "dst_id") == rows(graph.disease_subgraph(edges, disease), "type", "src_id", "dst_id")
