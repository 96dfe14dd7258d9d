"""What a task holds, and what is shuffled, does not grow faster than the tables: shapes of plans, and parts of what is written."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandgraph.operators import staging, trigrams, vector_index
from strandgraph.plans import catalog, discovery, loaders, upkeep  # noqa: F401

from . import oracle


def plan(spark, name):
    return catalog.queries()[name](spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString()


def below(text, outer, inner):
    """Whether each line with outer has one with inner under it."""
    lines = [(len(line) - len(line.lstrip(" :+-")), line) for line in text.splitlines()]
    found = [(i, depth) for i, (depth, line) in enumerate(lines) if outer in line]
    under = lambda i, depth: next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), len(lines))
    return bool(found) and all(any(inner in line for _, line in lines[i + 1 : under(i, depth)]) for i, depth in found)


@pytest.mark.parametrize("name", ["subgraphs_of_all", "subgraph_edges"])
def test_views_are_not_made_distinct_once_more(spark, name):
    assert plan(spark, name).startswith("Union")


def test_only_edges_that_a_front_meets_are_grouped(spark):
    assert below(plan(spark, "neighbours_two_hops"), "Aggregate [l_partkey", "LeftSemi")


@pytest.mark.parametrize("name, key", [("load_patent_edges", "p_partkey"), ("load_mesh_aliases", "c_custkey"), ("load_trial_edges", "o_custkey"), ("label_lookup_aliases", "c_custkey")])
def test_payloads_are_dealt_before_they_are_parsed(spark, name, key):
    assert f"RepartitionByExpression [{key}" in plan(spark, name)


@pytest.mark.parametrize("name, parser", [("load_mesh_aliases", "from_xml("), ("load_trial_edges", "from_json(")])
def test_a_payload_is_parsed_once(spark, name, parser):
    assert plan(spark, name).lower().replace("xmltostructs(", "from_xml(").replace("jsontostructs(", "from_json(").count(parser) == 1


def test_partitions_grow_with_rows(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert staging.partitions(spark, 0) == usual
    assert staging.partitions(spark, 100 * usual, 10) == 10 * usual


def test_postings_of_one_run_are_cut(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "TASK_POSTINGS", 2000)
    index = trigrams.TrigramIndex.build(spark.range(8000).select("id", F.lit("aaa").alias("name")))
    assert index.parts == 12
    assert index.table().where("gram = 'aaa'").select(F.input_file_name()).distinct().count() > 2
    assert index.candidates("aaa").count() == 8000


def test_a_task_hands_on_few_probes_at_once(monkeypatch):
    monkeypatch.setattr(vector_index, "HANDED", 4)
    monkeypatch.setattr(vector_index, "HELD", 30)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([[float(i), 1.0] for i in range(20)])], names=["query", "unit"])
    cut = list(vector_index.slices([batch], 10))
    assert [b.num_rows for b in cut] == [3, 3, 3, 3, 3, 3, 2]
    at = np.repeat(np.arange(3), 5)
    out = [b for b in vector_index.handed(cut[1], at, np.arange(15))]
    assert [b.num_rows for b in out] == [4, 4, 4, 3]
    assert sum((b.column(0).to_pylist() for b in out), []) == (at + 3).tolist()
    assert sum((b.column(2).to_pylist() for b in out), []) == list(range(15))


def test_edges_are_told_by_identifiers_without_a_join(spark):
    assert plan(spark, "cascade_levels").count("Join Inner") == 2  # those that make inhibits and for_condition


def test_texts_are_shuffled_rather_than_their_words(spark):
    assert below(plan(spark, "case_insensitive_dedupe"), "Generate posexplode", "RepartitionByExpression [doc_id")
