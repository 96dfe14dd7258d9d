"""Queries over whole inputs, against brute force: nothing beyond a prefix, an id bound or one language is left out."""

import duckdb

from strandgraph.plans import catalog

from . import oracle


def rows_of(table):
    return duckdb.sql(f"SELECT * FROM '{oracle.DATA}/{table}.parquet'").df().to_dict("records")


def test_case_insensitive_dedupe_reads_every_document_to_its_end(spark):
    docs = rows_of("documents")
    first = {}
    for d in docs:
        for i, w in enumerate(d["text"].split(" "), 1):
            if w:
                first.setdefault((d["doc_id"], w.lower()), i)
    found = {(r.doc_id, r.term): r.pos for r in catalog.queries()["case_insensitive_dedupe"](spark, oracle.DATA).collect()}
    assert len({d["lang"] for d in docs}) > 1 and max(len(d["text"]) for d in docs) > 400
    assert found == first


def test_merges_take_every_event_and_every_customer(spark, tmp_path):
    # Customers above the former bounds, and events of users who are no customers.
    customers = [(k, f"S{k % 5}") for k in (0, 59, 60, 199, 200, 900)]
    events = [(i, u, 10 - i if u == 60 else i, f"v{i}") for i, u in enumerate([0, 60, 60, 200, 200, 900, 7000, 7000, 0, 8000])]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, t int, props string").selectExpr("event_id", "user_id", "timestamp_ntz '2024-01-01' + make_dt_interval(t) AS ts", "props").write.parquet(f"{tmp_path}/events.parquet")
    last, first = dict(customers), dict(customers)
    for i, u, t, v in sorted(events, key=lambda e: (e[2], e[0])):
        last[u] = v
        first.setdefault(u, v)
    for name, expected in (("upsert_last_wins", last), ("insert_if_absent", first)):
        rows = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert len(rows) == len(expected) and {r.cache_key: r.value_json for r in rows} == expected, name


def test_label_cache_aside_resolves_every_customer(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 1, 2, 399, 400, 401, 402)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "Acme"), (401, "Basel"), (402, "Core")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    # At 15 February the entries of users 400 and 401 are live, that of user 402 is not.
    events = [(1, 400, 30, '{"k": "a"}'), (2, 400, 29, '{"k": "b"}'), (3, 401, 20, '{"k": "c"}'), (4, 402, 1, '{"k": "d"}')]
    spark.createDataFrame(events, "event_id long, user_id long, t int, props string").selectExpr("event_id", "user_id", "timestamp_ntz '2024-01-01' + make_dt_interval(t) AS ts", "props").write.parquet(f"{tmp_path}/events.parquet")
    rows = catalog.queries()["label_cache_aside"](spark, str(tmp_path)).collect()
    expected = {"Q0": "Wikidata:Q0", "Q1": "Acme", "Q2": "Wikidata:Q2", "Q399": "Wikidata:Q399", "Q400": "b", "Q401": "c", "Q402": "Core"}
    assert len(rows) == len(expected) and {r.qid: r.label for r in rows} == expected
