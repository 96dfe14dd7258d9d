"""A small invented graph as literal rows, for demonstrations and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRUGS = [("DEMO1", "Alpharil"), ("DEMO2", "Betacin"), ("DEMO3", "Gammavir"), ("DEMO4", "Deltamab"), ("DEMO5", "Epsilonib"), ("DEMO6", "Zetastat"), ("DEMO7", "Etaprim")]
TARGETS = [("T1", "First receptor"), ("T2", "Second receptor"), ("T3", "First kinase"), ("T4", "Second kinase"), ("T5", "First channel"), ("T6", "Second channel"), ("T7", "Transporter")]
DISEASES = [("M1", "Red fever"), ("M2", "Blue cough"), ("M3", "Green ache"), ("M4", "White chill"), ("M5", "Grey fatigue"), ("M6", "Amber itch")]
COMPANIES = [("1", "Northwind Bio"), ("22", "Southgate Pharma")]
#: Drug, target, score; and disease, target, score, two of diseases that no row names.
INHIBITS = [("DEMO1", "T1", 0.9), ("DEMO2", "T2", 0.8), ("DEMO3", "T3", 0.7), ("DEMO4", "T4", 0.6), ("DEMO5", "T5", 0.5), ("DEMO6", "T6", 0.4), ("DEMO7", "T7", 0.3)]
ASSOCIATED = [("M1", "T1", 0.95), ("M2", "T2", 0.85), ("M3", "T3", 0.75), ("M4", "T4", 0.65), ("M5", "T5", 0.55), ("M6", "T6", 0.45), ("M8", "T1", 0.35), ("M9", "T2", 0.25)]


def entities(spark: SparkSession) -> DataFrame:
    """kind, canonical_id, name."""
    rows = [("drug", f"CHEMBL:{k}", n) for k, n in DRUGS] + [("target", f"OPENTARGETS:{k}", n) for k, n in TARGETS] + [("disease", f"MESH:{k}", n) for k, n in DISEASES] + [("company", f"cik:{k.zfill(10)}", n) for k, n in COMPANIES]
    return spark.createDataFrame(rows, "kind string, canonical_id string, name string")


def edges(spark: SparkSession) -> DataFrame:
    """Edges by natural keys, with scores; ends that are no entity are dropped when the edges are resolved."""
    rows = [("drug", f"CHEMBL:{a}", "inhibits", "target", f"OPENTARGETS:{b}", s) for a, b, s in INHIBITS] + [("disease", f"MESH:{a}", "associated_with", "target", f"OPENTARGETS:{b}", s) for a, b, s in ASSOCIATED]
    return spark.createDataFrame(rows, "src_kind string, src_cid string, type string, dst_kind string, dst_cid string, score double").withColumn("source", F.lit("demo"))
