"""op7 with a window that very many items share, and with very many windows."""

import time

from pyspark.sql import functions as F

from strandgraph.llm import decontam


def test_one_window_of_100_000_items(spark):
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit("one two three four").alias("text"))
    docs = spark.createDataFrame([(1, "zero One, two three FOUR five"), (2, "one two three"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in decontam.digest(decontam.find_contamination(docs, items, keep=["doc_id"], block_pairs=30_000)).collect()}
    assert (found[1]["n_hit"], found[1]["n_items"]) == (4, 100_000) and found[2]["n_items"] == found[3]["n_items"] == 0
    assert found[1]["items_sha256"] == decontam.sha256_of([str(i) for i in range(100_000)])


def test_a_million_windows_are_cut_to_those_that_occur(spark):
    """100,000 items of 19 words, ten windows each, of which three documents hold some: the documents are read twice, whatever the
    number of windows."""
    word = lambda k: F.concat(F.lit("w"), (F.col("id") * 19 + k).cast("string"))
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", *(word(k) for k in range(19))).alias("text")).repartition(4)
    run = lambda i, lo, hi: " ".join(f"W{i * 19 + k}" for k in range(lo, hi))
    docs = spark.createDataFrame([(1, f"a {run(77_777, 3, 14)} b"), (2, run(5, 0, 19)), (3, run(6, 0, 9)), (4, f"{run(8, 9, 19)} {run(9, 0, 10)}")], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.digest(decontam.find_contamination(docs, items, keep=["doc_id"])).collect()}
    print("seconds", round(time.time() - began, 1))
    sha = lambda *names: decontam.sha256_of(list(map(str, names)))
    assert found == {1: (11, 1, sha(77_777)), 2: (19, 1, sha(5)), 3: (0, 0, sha()), 4: (20, 2, sha(8, 9))}
