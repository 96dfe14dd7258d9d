import json

from strandgraph.streaming import ingest


def test_gate_keeps_known_documents_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    docs = [{"doc_id": 1, "checksum": "a", "observed_at": "2024-01-01T00:00:00", "entities": ["Asthma"]}, {"doc_id": 2, "checksum": "b", "observed_at": "2024-01-01T00:01:00", "entities": ["nothing"]}, {"doc_id": 3, "checksum": "a", "observed_at": "2024-01-01T00:02:00", "entities": ["ASTHMA"]}]
    (landing / "a.json").write_text("\n".join(map(json.dumps, docs)))
    labels = spark.createDataFrame([("asthma",)], "label string")
    stream = ingest.read_landed(spark, str(landing), "doc_id long, checksum string, observed_at timestamp, entities array<string>")
    ingest.start(stream, labels, f"{tmp_path}/kept", f"{tmp_path}/rejected", f"{tmp_path}/cp").awaitTermination(120)
    kept = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()]
    assert len(kept) == 1 and kept[0] in (1, 3)
    assert [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/rejected").collect()] == [2]
