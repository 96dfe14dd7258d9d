"""The graph's tables as views of a star schema: entities, edges and the evidence model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import dealt, partitions
from ..schemas import KINDS, LICENSES

BASE = 10**10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_of(kind: str, key: Column) -> Column:
    return F.lit(KINDS[kind] * BASE) + key.cast("long")


#: An entity's identifier by kind, from its key.
CIDS = {
    "disease": lambda key: F.concat(F.lit("MESH:"), key.cast("string")),
    "target": lambda key: F.concat(F.lit("OPENTARGETS:"), key.cast("string")),
    "drug": lambda key: F.concat(F.lit("CHEMBL:"), key.cast("string")),
    "company": lambda key: F.concat(F.lit("cik:"), F.lpad(key.cast("string"), 10, "0")),
    "trial": lambda key: F.concat(F.lit("NCT:"), key.cast("string")),
}


def canonical_id(kind: Column, number: Column) -> Column:
    """The identifier of an entity by its kind and id, so that edges need no join to be told by it."""
    return F.coalesce(*(F.when(kind == k, cid(number - F.lit(KINDS[k] * BASE))) for k, cid in CIDS.items()))


def _entity(df: DataFrame, kind: str, key: str, cid: Column, name: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), cid.alias("canonical_id"), id_of(kind, F.col(key)).alias("id"), name.alias("name"))


def entities(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """kind, canonical_id, id, name; only the tables of the kinds asked for are read."""
    t = lambda n: read(spark, sf_dir, n)
    cid = lambda kind, key: CIDS[kind](F.col(key))
    made = {
        "disease": lambda: _entity(t("nation"), "disease", "n_nationkey", cid("disease", "n_nationkey"), F.col("n_name")),
        "target": lambda: _entity(t("customer"), "target", "c_custkey", cid("target", "c_custkey"), F.col("c_name")),
        "drug": lambda: _entity(t("part"), "drug", "p_partkey", cid("drug", "p_partkey"), F.col("p_name")),
        "company": lambda: _entity(t("supplier"), "company", "s_suppkey", cid("company", "s_suppkey"), F.col("s_name")),
        "trial": lambda: _entity(t("orders"), "trial", "o_orderkey", cid("trial", "o_orderkey"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))),
    }
    out = None
    for kind in kinds or made:
        out = made[kind]() if out is None else out.unionByName(made[kind]())
    return out


def _edge(df: DataFrame, kind: str, src: tuple[str, str], dst: tuple[str, str], score: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), id_of(src[0], F.col(src[1])).alias("src_id"), id_of(dst[0], F.col(dst[1])).alias("dst_id"), F.lit(src[0]).alias("src_kind"), F.lit(dst[0]).alias("dst_kind"), score.cast("double").alias("score"))


def edges(spark: SparkSession, sf_dir: str, types: list[str] | None = None, least: float | None = None) -> DataFrame:
    """type, src_id, dst_id, src_kind, dst_kind, score; only what the types asked for need is read. With a least score, scored edges
    below it are left out: a maximum reaches it if one of its values does, so the others are never read. Of large tables, joins and groups are dealt
    over partitions that grow with the lines (counted from the file's footers), so that no task's memory does."""
    t = lambda n: read(spark, sf_dir, n)
    null = F.lit(None)
    scored = lambda: t("lineitem") if least is None else t("lineitem").where(F.col("l_discount") >= least)
    n = partitions(spark, t("lineitem").count()) if types is None or {"inhibits", "manufactured_by", "sponsored_by", "studies"} & set(types) else None
    ordered = lambda: dealt(scored(), n, "l_orderkey").join(dealt(t("orders").select("o_orderkey", "o_custkey"), n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = {
        "associated_with": lambda: _edge(t("customer"), "associated_with", ("disease", "c_nationkey"), ("target", "c_custkey"), (F.col("c_custkey") % 101) / F.lit(100.0)),
        "inhibits": lambda: _edge(dealt(ordered(), n, "l_partkey", "o_custkey").groupBy("l_partkey", "o_custkey").agg(F.max("l_discount").alias("s")), "inhibits", ("drug", "l_partkey"), ("target", "o_custkey"), F.col("s")),
        "manufactured_by": lambda: _edge(dealt(scored(), n, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("s")), "manufactured_by", ("drug", "l_partkey"), ("company", "l_suppkey"), F.col("s")),
        "sponsored_by": lambda: _edge(dealt(t("lineitem"), n, "l_orderkey").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("k")), "sponsored_by", ("trial", "l_orderkey"), ("company", "k"), null),
        "studies": lambda: _edge(dealt(t("lineitem").select("l_orderkey", "l_partkey"), n, "l_orderkey").distinct(), "studies", ("trial", "l_orderkey"), ("drug", "l_partkey"), null),
        "for_condition": lambda: _edge(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), "for_condition", ("trial", "o_orderkey"), ("disease", "c_nationkey"), null),
    }
    out = None
    for kind in types or made:
        out = made[kind]() if out is None else out.unionByName(made[kind]())
    return out


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence: source, snippet, checksum, licence by doc_id, observed a day apart."""
    names = F.array(*(F.lit(n) for n, _ in LICENSES))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("evidence_id"),
        F.col("source").alias("source_system"),
        F.substring("text", 1, 500).alias("snippet"),
        F.sha2("text", 256).alias("checksum"),
        F.element_at(names, (F.col("doc_id") % 9 + 1).cast("int")).alias("license"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("observed_on"),
        "lang",
    )


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assertions, valid from a day of doc_id for a while, or still."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    key = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(key.alias("assertion_id"), day(key % 300).alias("effective_from"), F.when(key % 4 != 0, day(key % 300 + key % 90)).alias("effective_to"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as the bridge from assertions to evidence."""
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("assertion_id"), F.col("doc_id").alias("evidence_id"), "quality")


def licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENSES, "license string, is_commercial_safe boolean")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leaves of a tree by region and nation: id and dotted tree_number."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    nation = read(spark, sf_dir, "nation")
    return read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ui"), F.concat(F.lit("C"), pad("n_regionkey", 2), F.lit("."), pad("c_nationkey", 3), F.lit("."), pad("c_custkey", 8)).alias("tree_number"))


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries by user, each live for thirty days."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("cache_key"), "event_id", "ts", F.col("props").alias("value_json"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as entities with names: label and id; a name of four words, and as aliases its first two and the two after it."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    names = F.array(F.slice(w, 1, 4), F.slice(w, 1, 2), F.slice(w, 5, 2))
    return read(spark, sf_dir, "benchmark").select(F.explode(F.transform(names, lambda n: F.array_join(n, " "))).alias("label"), F.col("item_id").alias("id"))
