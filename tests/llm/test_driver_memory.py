"""What the driver holds and plans: many tables and long chains of columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm import common, quality_mcd


def test_staged_tables_are_held_by_path_alone(spark):
    since = common.staged()
    one, two = (common.stage(spark.range(n), "held") for n in (3, 4))
    assert not any(isinstance(t, DataFrame) for t in common._STAGED)
    common.sweep(since, two)
    assert [t.staged_path for t in common._STAGED[since:]] == [two.staged_path] and two.count() == 4
    common.drop(two)
    assert common.staged() == since


def test_a_chain_is_one_analysis(spark, monkeypatch):
    """Steps may name steps before them; the driver makes one plan for all, where each step made one."""
    made, kind = [], type(spark.range(1))
    monkeypatch.setattr(kind, "__init__", lambda self, *a, f=kind.__init__, **b: (made.append(1), f(self, *a, **b))[1])
    df = spark.range(1, 4).select(*(F.col("id").cast("double").alias(f"c_{i}_{j}") if i == j else F.lit(0.25).alias(f"c_{i}_{j}") for i, j in quality_mcd.PAIRS))
    made.clear()
    out = quality_mcd.chain(df, quality_mcd.cholesky_sql())
    assert len(made) <= 2  # 30 for 15 steps before: withColumn makes two frames
    found = out.collect()[1].asDict()
    l = {(i, j): found[f"l_{i}_{j}"] for i, j in quality_mcd.PAIRS}  # noqa: E741
    for i, j in quality_mcd.PAIRS:
        assert abs(sum(l[i, k] * l[j, k] for k in range(j + 1)) - found[f"c_{i}_{j}"]) < 1e-12
