"""Registry: every query of the engine over the star tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import search as Q
from ..operators import stats as C
from ..operators import store as W
from ..operators import vectors as V
from ..operators.staging import partitions
from ..sources import star

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

B = star.BASE
ENTITY = f"""entity AS (
 SELECT 'disease' AS kind, 'MESH:' || n_nationkey AS canonical_id, {1 * B} + n_nationkey AS id, n_name AS name FROM nation
 UNION ALL SELECT 'target', 'OPENTARGETS:' || c_custkey, {2 * B} + c_custkey, c_name FROM customer
 UNION ALL SELECT 'drug', 'CHEMBL:' || p_partkey, {3 * B} + p_partkey, p_name FROM part
 UNION ALL SELECT 'company', 'cik:' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0'), {4 * B} + s_suppkey, s_name FROM supplier
 UNION ALL SELECT 'trial', 'NCT:' || o_orderkey, {5 * B} + o_orderkey, o_orderpriority || ' ' || o_orderkey FROM orders)"""
EDGE = f"""edge AS (
 SELECT 'associated_with' AS type, {1 * B} + c_nationkey AS src_id, {2 * B} + c_custkey AS dst_id, 'disease' AS src_kind, 'target' AS dst_kind, (c_custkey % 101) / 100.0::DOUBLE AS score FROM customer
 UNION ALL SELECT 'inhibits', {3 * B} + l_partkey, {2 * B} + o_custkey, 'drug', 'target', max(l_discount) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_custkey
 UNION ALL SELECT 'manufactured_by', {3 * B} + l_partkey, {4 * B} + l_suppkey, 'drug', 'company', max(l_discount) FROM lineitem GROUP BY l_partkey, l_suppkey
 UNION ALL SELECT 'sponsored_by', {5 * B} + l_orderkey, {4 * B} + min(l_suppkey), 'trial', 'company', NULL FROM lineitem GROUP BY l_orderkey
 UNION ALL SELECT DISTINCT 'studies', {5 * B} + l_orderkey, {3 * B} + l_partkey, 'trial', 'drug', NULL FROM lineitem
 UNION ALL SELECT 'for_condition', {5 * B} + o_orderkey, {1 * B} + c_nationkey, 'trial', 'disease', NULL FROM orders JOIN customer ON o_custkey = c_custkey)"""
EVIDENCE = """license_list AS (SELECT * FROM (VALUES ('CC0', true), ('CC-BY-4.0', true), ('ODbL', true), ('OGL-UK-3.0', true), ('MIT', true), ('Apache-2.0', true), ('PROPRIETARY', false), ('CC-BY-NC', false), ('ALL_RIGHTS_RESERVED', false)) t(license, is_commercial_safe)),
evidence AS (SELECT doc_id AS evidence_id, source AS source_system, substr(text, 1, 500) AS snippet, sha256(text) AS checksum, ['CC0', 'CC-BY-4.0', 'ODbL', 'OGL-UK-3.0', 'MIT', 'Apache-2.0', 'PROPRIETARY', 'CC-BY-NC', 'ALL_RIGHTS_RESERVED'][doc_id % 9 + 1] AS license, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS observed_on FROM documents)"""
ASSERTION = """assertion AS (SELECT doc_id AS assertion_id, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS effective_from, CASE WHEN doc_id % 4 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 300 + doc_id % 90 AS INTEGER) AS DATE) END AS effective_to FROM documents)"""
TREE = """tree AS (SELECT c_custkey AS ui, 'C' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '.' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '.' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS tree_number FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
STRIP_CLASS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x85\x1C-\x1F]+"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def entities(spark, sf_dir, *kinds):
    return star.entities(spark, sf_dir, list(kinds) or None)


def edges(spark, sf_dir, *types):
    return star.edges(spark, sf_dir, list(types) or None)


#: Bytes of texts whose words one task groups, about.
TASK_TEXT = 1 << 23
SCORED = ("associated_with", "inhibits", "manufactured_by")


@query(f"WITH {ENTITY} SELECT kind, count(*) AS count FROM entity GROUP BY kind")
def stats_by_kind(spark, sf_dir):
    return C.by_kind(entities(spark, sf_dir))


@query(f"WITH {EDGE} SELECT count(*) AS edges FROM edge")
def edge_count(spark, sf_dir):
    return C.edge_count(edges(spark, sf_dir))


@query(f"WITH {EDGE} SELECT type, count(*) AS edges, count(score) AS scored FROM edge GROUP BY type")
def edge_types(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("edges"), F.count("score").alias("scored"))


@query(f"WITH {ENTITY} SELECT count(*) FILTER (kind = 'drug') AS drugs, count(*) FILTER (kind = 'company') AS companies, count(*) FILTER (kind = 'disease') AS diseases FROM entity")
def kind_counts_filtered(spark, sf_dir):
    return entities(spark, sf_dir, "drug", "company", "disease").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("drug", "drugs"), ("company", "companies"), ("disease", "diseases"))))


@query(f"WITH {ENTITY} SELECT * FROM entity WHERE name ILIKE '%re%' ESCAPE '\\' ORDER BY id LIMIT 20")
def search_name(spark, sf_dir):
    return Q.search(entities(spark, sf_dir), "Re")


@query(f"WITH {ENTITY} SELECT * FROM entity WHERE kind = 'drug' AND name ILIKE '%al%' ESCAPE '\\' ORDER BY id LIMIT 20")
def search_name_kind(spark, sf_dir):
    return Q.search(entities(spark, sf_dir), " al ", "drug")


@query(f"WITH {ENTITY} SELECT * FROM entity WHERE name ILIKE '%a_%e%' ESCAPE '\\' ORDER BY id LIMIT 20")
def search_wildcard(spark, sf_dir):
    return Q.search(entities(spark, sf_dir), "a_%e")


@query(f"WITH {ENTITY} SELECT * FROM entity WHERE name ILIKE '%#0000%' ESCAPE '\\' ORDER BY id LIMIT 20")
def search_escaped(spark, sf_dir):
    return Q.search(entities(spark, sf_dir), "\\#0000")


@query(f"WITH {ENTITY} SELECT * FROM entity WHERE kind = 'company' ORDER BY id LIMIT 200")
def list_entities(spark, sf_dir):
    return Q.list_entities(entities(spark, sf_dir), "company", 500)


@query(f"WITH {EDGE} SELECT * FROM edge WHERE type = 'inhibits' ORDER BY type, src_id, dst_id LIMIT 50")
def list_edges_by_type(spark, sf_dir):
    return Q.list_edges(edges(spark, sf_dir), "inhibits")


@query(f"WITH {ENTITY} SELECT id, name, kind FROM entity WHERE kind <> 'trial'")
def graph_nodes(spark, sf_dir):
    return entities(spark, sf_dir, "disease", "target", "drug", "company").select("id", "name", "kind")


DECORATED = "SELECT e.type, e.src_id, s.name AS src_name, e.src_kind, e.dst_id, d.name AS dst_name, e.dst_kind, coalesce(e.score, 0) AS score FROM edge e JOIN entity s ON e.src_id = s.id JOIN entity d ON e.dst_id = d.id"


@query(f"WITH {ENTITY}, {EDGE} {DECORATED} WHERE e.type IN ('associated_with', 'inhibits', 'manufactured_by') AND coalesce(e.score, 0) >= 0.05")
def graph_edges_min_score(spark, sf_dir):
    return G.decorated(G.at_least(star.edges(spark, sf_dir, list(SCORED), 0.05), 0.05), entities(spark, sf_dir, "disease", "target", "drug", "company"))


def flagship(spark, sf_dir):
    return graph_edges_min_score(spark, sf_dir)


@query(f"WITH {ENTITY}, {EDGE} {DECORATED} WHERE e.type = 'sponsored_by'")
def unscored_edges(spark, sf_dir):
    return G.decorated(G.at_least(edges(spark, sf_dir, "sponsored_by"), 0.0), entities(spark, sf_dir, "trial", "company"))


@query(f"WITH {ENTITY}, {EDGE} SELECT src_name, dst_name FROM ({DECORATED}) WHERE type = 'manufactured_by'")
def edge_type_pairs(spark, sf_dir):
    return G.decorated(edges(spark, sf_dir, "manufactured_by"), entities(spark, sf_dir, "drug", "company")).select("src_name", "dst_name")


@query(f"WITH {ENTITY}, {EDGE} SELECT type, src_name, dst_name FROM ({DECORATED}) WHERE dst_kind = 'company'")
def edges_to_kind(spark, sf_dir):
    return G.decorated(edges(spark, sf_dir), entities(spark, sf_dir)).where("dst_kind = 'company'").select("type", "src_name", "dst_name")


@query(f"WITH {EDGE} SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edge UNION ALL SELECT dst_id FROM edge WHERE src_id <> dst_id) GROUP BY id")
def degree(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


SUBGRAPH = f"""WITH {EDGE}, g AS (SELECT * FROM edge WHERE type IN ('associated_with', 'inhibits', 'manufactured_by')),
a AS (SELECT * FROM g WHERE src_id = {B} AND dst_kind = 'target'),
b AS (SELECT * FROM g WHERE src_kind = 'drug' AND (dst_id = {B} OR dst_id IN (SELECT dst_id FROM a))),
c AS (SELECT * FROM g WHERE dst_kind = 'company' AND src_kind = 'drug' AND src_id IN (SELECT src_id FROM b)),
u AS (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c)"""


@query(f"{SUBGRAPH} SELECT * FROM u")
def subgraph_edges(spark, sf_dir):
    """Each hop aggregates the scored edges that its front meets, and no others."""
    return G.disease_subgraph(edges(spark, sf_dir, *SCORED), B)


@query(f"{SUBGRAPH}, {ENTITY} SELECT id, name, kind FROM entity WHERE id = {B} OR id IN (SELECT src_id FROM u) OR id IN (SELECT dst_id FROM u)")
def subgraph_nodes(spark, sf_dir):
    ids = G.nodes_of(G.disease_subgraph(edges(spark, sf_dir, *SCORED), B), B)
    return entities(spark, sf_dir, "disease", "target", "drug", "company").join(ids, "id", "left_semi").select("id", "name", "kind")


@query(f"""WITH RECURSIVE {EDGE}, e AS (SELECT src_id AS a, dst_id AS b FROM edge WHERE type IN ('associated_with', 'manufactured_by') UNION SELECT dst_id, src_id FROM edge WHERE type IN ('associated_with', 'manufactured_by')),
walk(id, hop) AS (SELECT {4 * B}, 0 UNION SELECT b, hop + 1 FROM walk JOIN e ON a = id WHERE hop < 2) SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY id""")
def neighbours_two_hops(spark, sf_dir):
    start = spark.range(1).select(F.lit(4 * B).cast("long").alias("id"))
    return G.neighbours(edges(spark, sf_dir, "associated_with", "manufactured_by"), start, 2)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE CASE WHEN o_orderkey % 7 = 0 THEN true ELSE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' END")
def date_window_nulls(spark, sf_dir):
    from ..sources.payloads import in_window

    day = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date"))
    return star.read(spark, sf_dir, "orders").where(in_window(day, "1996-01-01", "1996-12-31")).select("o_orderkey", "o_orderdate")


@query("SELECT p_partkey, p_brand AS mesh_id FROM part WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#21', 'Brand#33')")
def mesh_semi_filter(spark, sf_dir):
    return Q.matching(star.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("mesh_id")), ["Brand#1", "Brand#12", "Brand#21", "Brand#33"])


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R' AND l_linestatus = 'F')")
def nested_any_match(spark, sf_dir):
    hit = F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    return star.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(hit.alias("hit"), F.count("*").alias("lines")).where("hit").select("l_orderkey", "lines")


@query(f"WITH {TREE} SELECT ui FROM tree WHERE tree_number LIKE 'C01%' OR tree_number LIKE 'C03%'")
def tree_prefix_any(spark, sf_dir):
    return star.trees(spark, sf_dir).withColumn("trees", F.array("tree_number")).where(F.exists("trees", lambda t: t.startswith("C01") | t.startswith("C03"))).select("ui")


@query(f"WITH {TREE} SELECT ui, tree_number FROM tree WHERE tree_number = 'C02' OR starts_with(tree_number, 'C02.')")
def tree_descendants(spark, sf_dir):
    return G.descendants(star.trees(spark, sf_dir), "C02")


PAIRS = "pairs AS (SELECT DISTINCT 'CHEMBL:' || l_partkey AS src_cid, 'cik:' || lpad(CAST(l_suppkey + 3 AS VARCHAR), 10, '0') AS dst_cid FROM lineitem)"


@query(f"WITH {ENTITY}, {PAIRS} SELECT p.src_cid, p.dst_cid, s.id AS src_id, d.id AS dst_id FROM pairs p JOIN entity s ON s.kind = 'drug' AND s.canonical_id = p.src_cid JOIN entity d ON d.kind = 'company' AND d.canonical_id = p.dst_cid")
def edge_resolve(spark, sf_dir):
    pairs = star.read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().select(F.lit("drug").alias("src_kind"), F.concat(F.lit("CHEMBL:"), F.col("l_partkey").cast("string")).alias("src_cid"), F.lit("company").alias("dst_kind"), F.concat(F.lit("cik:"), F.lpad((F.col("l_suppkey") + 3).cast("string"), 10, "0")).alias("dst_cid"))
    return G.resolve(pairs, entities(spark, sf_dir, "drug", "company")).select("src_cid", "dst_cid", "src_id", "dst_id")


@query(f"WITH {ENTITY} SELECT e.id, e.name, s.s_name AS alias FROM entity e LEFT JOIN supplier s ON s.s_nationkey + {B} = e.id WHERE e.kind = 'disease'")
def entity_alias_left(spark, sf_dir):
    alias = star.read(spark, sf_dir, "supplier").select(star.id_of("disease", F.col("s_nationkey")).alias("id"), F.col("s_name").alias("alias"))
    return entities(spark, sf_dir, "disease").join(alias, "id", "left").select("id", "name", "alias")


@query(f"WITH {ENTITY}, labels_ AS (SELECT lower(name) AS label, min(id) AS id FROM entity WHERE kind = 'drug' GROUP BY 1) SELECT p_partkey, l.id AS matched FROM part JOIN labels_ l ON lower(p_name) = l.label")
def label_lookup_join(spark, sf_dir):
    labels = G.label_lookup(entities(spark, sf_dir, "drug"))
    return star.read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("label")).join(labels, "label").select("p_partkey", F.col("id").alias("matched"))


@query(f"WITH {EVIDENCE}, {ASSERTION} SELECT a.assertion_id, e.source_system, e.license FROM assertion a JOIN labels l ON l.doc_id = a.assertion_id JOIN evidence e ON e.evidence_id = l.doc_id")
def evidence_bridge(spark, sf_dir):
    return E.supported(star.assertions(spark, sf_dir), star.links(spark, sf_dir), star.evidence(spark, sf_dir)).select("assertion_id", "source_system", "license")


@query(f"WITH {EVIDENCE} SELECT e.evidence_id, e.license FROM evidence e LEFT JOIN license_list l USING (license) WHERE NOT coalesce(l.is_commercial_safe, false)")
def license_violations(spark, sf_dir):
    return E.violations(star.evidence(spark, sf_dir), star.licenses(spark)).select("evidence_id", "license")


@query("SELECT doc_id AS assertion_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def assertions_without_evidence(spark, sf_dir):
    return E.unsupported(star.assertions(spark, sf_dir), star.links(spark, sf_dir)).select("assertion_id")


@query(f"WITH {EVIDENCE} SELECT evidence_id, license FROM evidence WHERE license IN (SELECT license FROM license_list WHERE is_commercial_safe)")
def license_gate(spark, sf_dir):
    return E.accepted(star.evidence(spark, sf_dir), star.licenses(spark)).select("evidence_id", "license")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def orphans(spark, sf_dir):
    solvent = star.read(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    return W.orphans(star.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), solvent, ["l_suppkey"], ["s_suppkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark, sf_dir):
    gone = star.read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return W.cascade_delete(star.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"], ["c_custkey"])


@query("WITH new AS (SELECT user_id AS cache_key, props AS value_json FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1) SELECT * FROM new UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT cache_key FROM new)")
def upsert_last_wins(spark, sf_dir):
    present = star.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cache_key"), F.col("c_mktsegment").alias("value_json"))
    batch = star.cache_rows(spark, sf_dir).select("cache_key", "value_json", F.struct("ts", "event_id").alias("seq"))
    return W.upsert(present, batch, ["cache_key"], "seq")


@query("WITH old AS (SELECT c_custkey AS cache_key, c_mktsegment AS value_json FROM customer) SELECT * FROM old UNION ALL SELECT user_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 AND user_id NOT IN (SELECT cache_key FROM old)")
def insert_if_absent(spark, sf_dir):
    present = star.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cache_key"), F.col("c_mktsegment").alias("value_json"))
    batch = star.cache_rows(spark, sf_dir).select("cache_key", "value_json", F.struct("ts", "event_id").alias("seq"))
    return W.insert_if_absent(present, batch, ["cache_key"], "seq")


@query("SELECT user_id AS cache_key, event_id, substr(event_type || ':' || props, 1, 12) AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_write_wins(spark, sf_dir):
    rows = star.read(spark, sf_dir, "events")
    first = W.latest(rows, ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()])
    return first.select(F.col("user_id").alias("cache_key"), "event_id", F.substring(F.concat_ws(":", "event_type", "props"), 1, 12).alias("name"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k_old, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE json_extract_string(props, '$.k') END AS k_new, event_type AS t FROM events")
def json_merge(spark, sf_dir):
    right = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.lit("new").alias("k"), F.col("event_type").alias("t")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("t"))))
    merged = S.json_merge(F.col("props"), right)
    return star.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k_old"), merged["k"].alias("k_new"), merged["t"].alias("t"))


@query("SELECT doc_id, lower(w) AS term, min(i) AS pos FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) WHERE w <> '' GROUP BY ALL")
def case_insensitive_dedupe(spark, sf_dir):
    """Texts are dealt by document before they are cut, so that texts are shuffled, once, and not their words."""
    docs = star.read(spark, sf_dir, "documents").select("doc_id", "text")
    parts = partitions(spark, docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], TASK_TEXT)
    words = docs.repartition(parts, "doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "w")).where("w <> ''")
    return words.groupBy("doc_id", F.lower("w").alias("term")).agg(F.min(F.col("p") + 1).cast("long").alias("pos"))


@query("SELECT l_partkey, l_orderkey, l_extendedprice, CAST(r AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity) AS r FROM lineitem) WHERE r <= 3")
def top_k_per_group(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_quantity")
    return star.read(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("l_partkey", "l_orderkey", "l_extendedprice", "place")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_feed(spark, sf_dir):
    return star.read(spark, sf_dir, "events").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("SELECT user_id AS cache_key, event_id FROM events WHERE ts + INTERVAL 30 DAY >= (SELECT max(ts) FROM events)")
def ttl_live(spark, sf_dir):
    rows = star.cache_rows(spark, sf_dir)
    return E.live(rows, rows.agg(F.max("ts")).scalar()).select("cache_key", "event_id")


@query("SELECT user_id AS cache_key, count(*) AS live FROM events WHERE ts + INTERVAL 30 DAY >= TIMESTAMP '2024-02-15 00:00:00' GROUP BY user_id")
def evict_expired(spark, sf_dir):
    return E.live(star.cache_rows(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-02-15 00:00:00'")).groupBy("cache_key").agg(F.count("*").alias("live"))


@query(f"WITH {EVIDENCE} SELECT checksum, min(evidence_id) AS evidence_id FROM evidence GROUP BY checksum")
def checksum_dedupe(spark, sf_dir):
    return E.distinct_content(star.evidence(spark, sf_dir)).select("checksum", "evidence_id")


@query(f"WITH {ASSERTION} SELECT assertion_id, effective_from, effective_to FROM assertion WHERE effective_from <= DATE '2024-06-01' AND (effective_to IS NULL OR DATE '2024-06-01' < effective_to)")
def as_of_assertions(spark, sf_dir):
    return E.as_of(star.assertions(spark, sf_dir), F.lit("2024-06-01").cast("date"))


@query(f"WITH {EVIDENCE} SELECT l.doc_id AS assertion_id FROM labels l JOIN evidence e ON e.evidence_id = l.doc_id GROUP BY l.doc_id HAVING bool_and(e.source_system = 'src0')")
def single_source_assertions(spark, sf_dir):
    ev = star.evidence(spark, sf_dir).withColumnRenamed("source_system", "evidence_type")
    return E.news_only(star.assertions(spark, sf_dir), star.links(spark, sf_dir), ev, "src0")


@query("SELECT p_partkey, array_to_string(list_filter(string_split_regex(replace(translate(replace(lower(p_name || ' & Co., (' || p_type || ')'), '&', ' and '), '/,().', '     '), '''', ''), '\\s+'), lambda w: w <> '')[1:12], '_') AS slug FROM part")
def slug(spark, sf_dir):
    return star.read(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat("p_name", F.lit(" & Co., ("), "p_type", F.lit(")"))).alias("slug"))


DATES = "CASE CAST(o_orderkey % 6 AS INTEGER) WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, ' %Y-%m ') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-31') WHEN 4 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dx') END"


@query(f"WITH t AS (SELECT o_orderkey, trim({DATES}) AS s FROM orders) SELECT o_orderkey, CAST(coalesce(CASE WHEN regexp_full_match(s, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime(s, '%Y-%m-%d') END, CASE WHEN regexp_full_match(s, '\\d{{4}}-\\d{{1,2}}') THEN try_strptime(s, '%Y-%m') END, CASE WHEN regexp_full_match(s, '\\d{{4}}') THEN try_strptime(s, '%Y') END) AS DATE) AS day FROM t")
def parse_date(spark, sf_dir):
    d = F.col("o_orderdate")
    shape = F.col("o_orderkey") % 6
    text = F.when(shape == 0, F.date_format(d, "yyyy-MM-dd")).when(shape == 1, F.date_format(d, " yyyy-MM ")).when(shape == 2, F.date_format(d, "yyyy")).when(shape == 3, F.date_format(d, "yyyy-MM-31")).when(shape == 4, "").otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("x")))
    return star.read(spark, sf_dir, "orders").select("o_orderkey", S.parse_date(text).alias("day"))


PHASE_SQL = "CASE left(o_orderpriority, 1) WHEN '1' THEN ['EARLY_PHASE1'] WHEN '2' THEN ['PHASE1', 'PHASE2'] WHEN '3' THEN ['phase3'] WHEN '4' THEN ['NA'] ELSE CAST([] AS VARCHAR[]) END"


def _phases():
    digit = F.substring("o_orderpriority", 1, 1)
    of = lambda *x: F.array(*(F.lit(v) for v in x))
    return F.when(digit == "1", of("EARLY_PHASE1")).when(digit == "2", of("PHASE1", "PHASE2")).when(digit == "3", of("phase3")).when(digit == "4", of("NA")).otherwise(F.array().cast("array<string>"))


@query(f"SELECT o_orderkey, nullif(array_to_string({PHASE_SQL}, ','), '') AS phase_raw FROM orders")
def phase_join(spark, sf_dir):
    return star.read(spark, sf_dir, "orders").select("o_orderkey", S.phase_join(_phases()).alias("phase_raw"))


@query(f"SELECT o_orderkey, CAST(CASE WHEN p LIKE '%PHASE4%' THEN 4 WHEN p LIKE '%PHASE3%' THEN 3 WHEN p LIKE '%PHASE2%' THEN 2 WHEN p LIKE '%PHASE1%' THEN 1 WHEN p LIKE '%EARLY%' THEN 1 END AS INTEGER) AS phase_max FROM (SELECT o_orderkey, upper(array_to_string({PHASE_SQL}, ',')) AS p FROM orders)")
def phase_max(spark, sf_dir):
    return star.read(spark, sf_dir, "orders").select("o_orderkey", S.phase_max(S.phase_join(_phases())).alias("phase_max"))


@query("SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, ''), nullif(o_orderstatus, ''), 'NCT:' || o_orderkey) AS title FROM orders")
def title_coalesce(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    return star.read(spark, sf_dir, "orders").select("o_orderkey", S.first_filled(first, F.col("o_orderstatus"), F.concat(F.lit("NCT:"), F.col("o_orderkey").cast("string"))).alias("title"))


@query("SELECT p_partkey, 'ORG:' || substr(regexp_replace(upper(p_name || '  ' || p_brand), '\\s+', '_', 'g'), 1, 120) AS org FROM part")
def org_key(spark, sf_dir):
    return star.read(spark, sf_dir, "part").select("p_partkey", S.org_key(F.concat("p_name", F.lit("  "), "p_brand")).alias("org"))


@query("SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS found FROM supplier")
def cik_pad(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    response = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<a><CIK>"), key, F.lit("</CIK></a>"))).otherwise("<a/>")
    return star.read(spark, sf_dir, "supplier").select("s_suppkey", S.cik_pad(key).alias("cik"), S.cik_of(response).alias("found"))


@query("SELECT page_id, string_split(url, '/')[-1] AS tail FROM pages")
def uri_tail(spark, sf_dir):
    return star.read(spark, sf_dir, "pages").select("page_id", S.uri_tail(F.col("url")).alias("tail"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, '{\"score\":' || CAST(l_discount AS VARCHAR) || ',\"mesh_id\":\"D' || l_partkey || '\"}' AS props FROM lineitem WHERE l_discount > 0.005")
def json_build(spark, sf_dir):
    return star.read(spark, sf_dir, "lineitem").where("l_discount > 0.005").select("l_orderkey", "l_linenumber", "l_partkey", S.edge_props(F.col("l_discount"), F.concat(F.lit("D"), F.col("l_partkey").cast("string"))).alias("props"))


@query("SELECT event_id, TRY_CAST(json_extract_string(replace(props, '\"k\"', '\"score\"'), '$.score') AS DOUBLE) AS score FROM events")
def json_score(spark, sf_dir):
    return star.read(spark, sf_dir, "events").select("event_id", S.json_score(F.replace(F.col("props"), F.lit('"k"'), F.lit('"score"'))).alias("score"))


@query(f"WITH {EDGE} SELECT src_id, dst_id, round(greatest(0.5, 5 * score), 6) AS width, greatest(0.2, score) AS opacity FROM edge WHERE type = 'associated_with'")
def edge_style(spark, sf_dir):
    return G.styled(edges(spark, sf_dir, "associated_with")).select("src_id", "dst_id", F.round("width", 6).alias("width"), "opacity")


@query("SELECT w.q AS qid, coalesce(c.label, e.label, 'Wikidata:' || w.q) AS label FROM (SELECT 'Q' || c_custkey AS q, c_custkey AS k FROM customer) w LEFT JOIN (SELECT 'Q' || user_id AS q, max(json_extract_string(props, '$.k')) AS label FROM events WHERE ts + INTERVAL 30 DAY >= TIMESTAMP '2024-02-15 00:00:00' GROUP BY 1) c ON c.q = w.q LEFT JOIN (SELECT 'Q' || s_suppkey AS q, s_name AS label FROM supplier) e ON e.q = w.q")
def label_cache_aside(spark, sf_dir):
    key = lambda c: F.concat(F.lit("Q"), F.col(c).cast("string"))
    ids = star.read(spark, sf_dir, "customer").select(key("c_custkey").alias("qid"))
    now = F.expr("TIMESTAMP_NTZ '2024-02-15 00:00:00'")
    rows = E.live(star.cache_rows(spark, sf_dir), now).groupBy(key("cache_key").alias("cache_key")).agg(F.max(F.get_json_object("value_json", "$.k")).alias("label"), F.max("expires_at").alias("expires_at"))
    cache = rows.select("cache_key", F.to_json(F.struct("label")).alias("value_json"), "expires_at")
    landed = star.read(spark, sf_dir, "supplier").select(key("s_suppkey").alias("qid"), F.col("s_name").alias("label"))
    return E.label_of(ids, cache, landed, now)


@query("SELECT o_orderkey AS doc_id FROM orders WHERE lower(o_orderpriority) IN (SELECT DISTINCT lower(p) FROM (SELECT o_orderpriority AS p FROM orders WHERE left(o_orderpriority, 1) IN ('1', '3')))")
def ingest_gate(spark, sf_dir):
    from ..streaming.ingest import gate

    orders = star.read(spark, sf_dir, "orders")
    labels = orders.where("left(o_orderpriority, 1) IN ('1', '3')").select(F.lower("o_orderpriority").alias("label")).distinct()
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.array("o_orderpriority").alias("entities"))
    return gate(docs, labels)[0].select("doc_id")


ONES = ", ".join(["1.0"] * 64)


@query(f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(64)), 6) AS similarity FROM embeddings, (SELECT [{ONES}]::DOUBLE[] AS q) ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return V.nearest(star.read(spark, sf_dir, "embeddings"), [1.0] * 64, 10)


@query("SELECT c_mktsegment, c_nationkey, count(*) AS members FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY ALL")
def universe_members(spark, sf_dir):
    nation = star.read(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return star.read(spark, sf_dir, "customer").join(nation, "c_nationkey", "left_semi").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("members"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_order(spark, sf_dir):
    rows = star.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"), F.size("t").cast("long").alias("turns"))


@query("SELECT DISTINCT p_brand AS mesh_id FROM part")
def distinct_ids(spark, sf_dir):
    from ..sources.payloads import target_ids

    return target_ids(star.read(spark, sf_dir, "part").select(F.col("p_brand").alias("mesh_id")))


@query("SELECT p_partkey, p_name FROM part WHERE p_size IS NOT NULL ORDER BY p_name, p_partkey")
def ordered_names(spark, sf_dir):
    return star.read(spark, sf_dir, "part").where("p_size IS NOT NULL").select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


def queries() -> dict[str, Query]:
    from . import discovery, loaders, upkeep  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import discovery, loaders, upkeep  # noqa: F401

    return dict(_SQL)
