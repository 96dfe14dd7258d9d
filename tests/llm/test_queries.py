"""The registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from strandgraph.llm import bwt_dedup, common, oracles, queries

from .. import oracle
from . import brute


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    oracle.same(queries.queries()[name](spark, oracle.DATA), con, queries.oracle_sql()[name])


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_native_plans(spark):
    for name in ("op1_quality_rules", "op3_shard_placement"):
        plan = queries.queries()[name](spark, oracle.DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    """Each stage does on what the one before kept what brute force says."""
    table = docs
    items = spark.read.parquet(f"{oracle.DATA}/benchmark.parquet").collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = table.collect()
        out = stage(spark, table, oracle.DATA)
        out.write.parquet(f"{tmp_path}/{i}")
        table = spark.read.parquet(f"{tmp_path}/{i}")
        after = table.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert table.columns == docs.columns
        texts = [r["text"] for r in before] if "text" in before[0].__fields__ else []
        if name == "quality_rules":
            documents = pa.table({c: pa.array([r[c] for r in before], k) for c, k in (("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()))})
            verdicts = duckdb.connect().register("documents", documents).execute(oracles.quality_rules()).fetchall()
            assert sorted(str(r["doc_id"]) for r in after) == sorted(str(v[0]) for v in verdicts if v[-1])
            assert not any(brute.statistics(r["text"])[-1] for r in after)
        elif name == "near_duplicates":
            groups = brute.near_duplicates([(r["doc_id"], r["text"]) for r in before])
            assert len(after) == len({g[2] for g in groups})
        elif name == "repeated_passages":
            gone = brute.passages(texts, bwt_dedup.PASSAGE_WINDOW, bwt_dedup.PASSAGE_WORDS)
            assert sorted(len((r["text"] or "").encode()) for r in after) == sorted(len((t or "").encode()) - g[1] for t, g in zip(texts, gone))
        elif name == "decontamination":
            clean = [t for t in texts if not brute.contamination(t, [(r["item_id"], r["text"]) for r in items])[-1]]
            assert len(after) == len(clean)
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}



def test_run_leaves_no_more_than_its_last_stages_tables(spark, monkeypatch):
    """The stages' own tables are deleted once the next stage's input is written; what stays is read by the result."""
    since = common.staged()
    out = corpus_pipeline.run(spark, oracle.DATA)
    left = [t.staged_path.rsplit("/", 1)[1].split("-")[0] for t in common._STAGED[since:]]
    assert out.count() > 0 and left.count("decontamination") == 1
    assert not {"quality_rules", "near_duplicates", "repeated_passages", "sets", "postings", "statistics"} & set(left)


def test_scores_of_held_out_labels(spark):
    """The classifier on labels that its fit has never read, of the larger table."""
    data = oracle.DATA.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    rows = queries.op4_quality_score(spark, data).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
