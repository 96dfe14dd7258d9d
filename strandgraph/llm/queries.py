"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bwt_dedup, decontam, distinct_codes, drake_kmeans, html_crf, jaccard_join, license_rules, lm_mixing, oracles, packing, quality_mcd, shard_table, warc_bundles, zstd_quality
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.digest(quality_mcd.judge(table(spark, sf_dir, "documents")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_crf.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op3_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard."""
    return shard_table.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def op4_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = zstd_quality.fit(docs, table(spark, sf_dir, "labels"))
    return zstd_quality.digest(zstd_quality.score(docs, model, keep=["doc_id"]))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_rules.digest(license_rules.scan_licences(docs, keep=["doc_id"]))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(jaccard_join.near_duplicates(table(spark, sf_dir, "documents")))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bwt_dedup.digest(bwt_dedup.removal(docs, keep=["doc_id"], passages=True))


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.digest(warc_bundles.read_bundles(warc_bundles.write_bundles(table(spark, sf_dir, "pages"))))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_codes.digest(distinct_codes.encode(table(spark, sf_dir, "embeddings")))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm_mixing.fit(docs)
    return lm_mixing.digest(lm_mixing.score(docs, model, keep=["doc_id"]), model)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake_kmeans.digest(drake_kmeans.cluster(table(spark, sf_dir, "embeddings")))


def queries():
    return {f.__name__: f for f in (op1_quality_rules, op2_html_extraction, op3_shard_placement, op4_quality_score, op5_license_scan, op6_pack, op7_decontaminate, op8_jaccard_join, op9_repeated_passages, op10_warc_bundles, op11_vector_codes, op12_lm_score, op13_centroid_clusters)}


def oracle_sql():
    return {
        "op1_quality_rules": oracles.quality_rules(),
        "op3_shard_placement": oracles.shard_placement(),
        "op7_decontaminate": oracles.DECONTAMINATE,
        "op8_jaccard_join": oracles.JACCARD,
        "op10_warc_bundles": oracles.WARC,
        "op11_vector_codes": oracles.distinct_codes(),
        "op13_centroid_clusters": oracles.centroid_clusters(),
    }
