"""Queries of the loaders: payloads landed as text are made of the star tables, parsed with the declared schemas, and worked
on by the same functions that the loaders run; their DuckDB twins compute the rows straight from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph as G
from ..operators import search as Q
from ..operators.staging import partitions
from ..sources import payloads as P
from ..sources import star
from .catalog import ENTITY, entities, query


#: Payloads that one task parses, at most.
PAYLOADS = 1 << 14


def text(*parts: str | Column) -> Column:
    """Literals and columns, one after another."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def tasks(spark, sf_dir, table: str) -> int:
    """Tasks of PAYLOADS rows of a star table, about."""
    return partitions(spark, star.read(spark, sf_dir, table).count(), PAYLOADS)


def dealt_rows(spark, sf_dir, table: str, key: str) -> DataFrame:
    """A star table dealt over tasks: its file, small beside the payloads made of it, may be read by a single one."""
    return star.read(spark, sf_dir, table).repartition(tasks(spark, sf_dir, table), key)


def landed(df: DataFrame, json: Column, schema: str, *keep: str) -> DataFrame:
    """The fields of landed JSON texts, beside the columns kept. A generator gives them, so that each text is parsed once, whatever reads its fields."""
    return df.select(*keep, F.inline(F.array(F.from_json(json, schema))))


def study_pages(spark, sf_dir) -> DataFrame:
    key, customer = F.col("o_orderkey"), star.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = star.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n = tasks(spark, sf_dir, "orders")
    rows = dealt_rows(spark, sf_dir, "orders", "o_custkey").join(customer.repartition(n, "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    phases = F.when(key % 4 == 0, '"PHASE3"').when(key % 4 == 1, '["PHASE1","PHASE2"]').when(key % 4 == 2, "[]").otherwise("null")
    json = text(
        '{"protocolSection":{"identificationModule":{"nctId":"', F.when(key % 11 == 0, "").otherwise(text(" ", key, "\\t")), '","officialTitle":"', F.when(key % 3 == 0, "").otherwise(text(" ", F.col("o_orderpriority"))),
        '","briefTitle":"', F.col("o_orderstatus"), '"},"statusModule":{"overallStatus":" ', F.col("o_orderstatus"), ' ","startDateStruct":{"date":"', F.date_format("o_orderdate", "yyyy-MM"),
        '"}},"designModule":{"studyType":"T","phases":', phases, '},"sponsorCollaboratorsModule":{"leadSponsor":{"name":"', F.when(key % 5 == 0, " ").otherwise(text(F.col("c_mktsegment"), " & Co.")),
        '"}},"conditionsModule":{"conditions":[" ', F.lower("n_name"), '","nothing",""]},"armsInterventionsModule":{"interventions":[{"type":"', F.when(key % 2 == 0, "drug").otherwise("DEVICE"), '","name":" Item ', key % 50,
        '"},{"type":"Biological","name":""}]}}}',
    )
    return rows.select(F.struct("o_orderkey").alias("batch_seq"), F.explode(F.array(F.from_json(json, P.STUDY))).alias("s"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS nct_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS title, o_orderstatus AS overall_status, CASE o_orderkey % 4 WHEN 0 THEN 'PHASE3' WHEN 1 THEN 'PHASE1,PHASE2' END AS phase_raw, CAST(CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 END AS INTEGER) AS phase_max, CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date, CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment || ' & Co.' END AS sponsor_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 0")
def load_studies(spark, sf_dir):
    return P.study_rows(study_pages(spark, sf_dir)).select("nct_id", "title", "overall_status", "phase_raw", "phase_max", "start_date", "sponsor_name")


@query("""WITH t AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 0)
SELECT 'NCT:' || o_orderkey AS src_cid, 'sponsored_by' AS type, 'CTG_SPONSOR:' || lower(c_mktsegment) || '_and_co' AS dst_cid FROM t WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'NCT:' || o_orderkey, 'for_condition', 'MESH:' || c_nationkey FROM t UNION ALL SELECT 'NCT:' || o_orderkey, 'studies', 'CTG_INT:item_' || (o_orderkey % 50) FROM t WHERE o_orderkey % 2 = 0""")
def load_trial_edges(spark, sf_dir):
    labels = entities(spark, sf_dir, "disease").select(F.lower("name").alias("label"), "canonical_id")
    return P.trial_graph(P.study_rows(study_pages(spark, sf_dir)), labels, tasks(spark, sf_dir, "orders"))["edge"].select("src_cid", "type", "dst_cid")


@query("""SELECT 'D' || c_nationkey AS mesh_id, 'OPENTARGETS:E' || c_custkey AS canonical_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE (c_custkey % 100) / 128.0::DOUBLE END AS score
FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 13 <> 0""")
def load_associations(spark, sf_dir):
    key = F.col("c_custkey")
    target = text('{"target":{"id":"E', key, '","approvedSymbol":"', F.when(key % 7 == 0, "").otherwise(F.col("c_mktsegment")), '","approvedName":"', F.when(key % 2 == 0, "").otherwise(F.col("c_name")), '"},"score":', F.when(key % 3 == 0, "null").otherwise((key % 100 / 128.0).cast("string")), "}")
    json = text('{"mesh_id":"D', F.col("c_nationkey"), '","data":{"disease":{"associatedTargets":{"rows":[', target, "]}}}", F.when(key % 13 == 0, ',"errors":[{"message":"bad"}]').otherwise(""), "}")
    return P.association_rows(landed(star.read(spark, sf_dir, "customer"), json, P.ASSOCIATIONS)).select("mesh_id", "canonical_id", "name", "score")


@query("SELECT 'CHEMBL:T' || p_partkey AS canonical_id, p_name AS name FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 2 = 1 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#1', 'Brand#21')")
def load_targets(spark, sf_dir):
    key = F.col("p_partkey")
    json = text('{"results":[{"target_chembl_id":"T', key, '","pref_name":', F.when(key % 10 == 0, "null").otherwise(text('"', F.col("p_name"), '"')), ',"cross_references":[{"xref_id":"', F.col("p_brand"), '","xref_src":"', F.when(key % 2 == 1, "MeSH").otherwise("Other"), '"}]}]}')
    return P.target_rows(landed(star.read(spark, sf_dir, "part"), json, P.TARGETS), ["Brand#11", "Brand#12", "Brand#13", "Brand#1", "Brand#21"])


@query("SELECT s_name AS ticker, lpad(CAST(s_suppkey + 7 AS VARCHAR), 10, '0') AS cik FROM supplier WHERE s_suppkey % 3 <> 0")
def load_ciks(spark, sf_dir):
    key = F.col("s_suppkey")
    json = text('{"ticker":"', F.col("s_name"), '","response":"<feed>', F.when(key % 3 == 0, "").otherwise(text("<CIK>", key + 7, "</CIK>")), '</feed>"}')
    return P.cik_rows(landed(star.read(spark, sf_dir, "supplier"), json, "ticker string, response string"))


@query("SELECT s_name AS ticker, 'Q' || s_suppkey AS wikidata_id, CASE WHEN s_suppkey % 2 = 0 THEN '18' || (s_suppkey % 90 + 10) END AS founded, CASE WHEN s_suppkey % 3 = 0 THEN 'N' || s_nationkey END AS country FROM supplier WHERE s_suppkey % 4 <> 0")
def load_enrichment(spark, sf_dir):
    key = F.col("s_suppkey")
    one = text('{"company":{"value":"http://w/entity/Q', key, '"}', F.when(key % 2 == 0, text(',"founded":{"value":"18', key % 90 + 10, '"}')).otherwise(""), F.when(key % 3 == 0, text(',"countryLabel":{"value":"N', F.col("s_nationkey"), '"}')).otherwise(""), '},{"company":{"value":"http://w/entity/Q0"}}')
    json = text('{"ticker":"', F.col("s_name"), '","results":{"bindings":[', F.when(key % 4 == 0, "").otherwise(one), "]}}")
    return P.enrichment_rows(landed(star.read(spark, sf_dir, "supplier"), json, P.BINDINGS)).select("ticker", "wikidata_id", "founded", "country")


@query("""WITH p AS (SELECT p_partkey, 10 * p_partkey + i AS n, p_brand, p_type FROM part, range(3) t(i) WHERE NOT (i = 1 AND p_partkey % 6 = 0)),
o AS (SELECT 'PATENT:' || n AS src_cid, 'ORG:' || replace(upper(p_brand), ' ', '_') AS dst_cid FROM p UNION SELECT 'PATENT:' || n, 'ORG:' || replace(upper(p_type), ' ', '_') FROM p WHERE p_partkey % 5 <> 0)
SELECT 'CHEMBL:' || p_partkey AS src_cid, 'protected_by' AS type, 'PATENT:' || n AS dst_cid FROM p UNION ALL SELECT src_cid, 'assigned_to', dst_cid FROM o""")
def load_patent_edges(spark, sf_dir):
    key = F.col("p_partkey")
    owners = text('"assignees":[{"assignee_organization":"', F.col("p_brand"), '"},{"assignee_organization":', F.when(key % 5 == 0, "null").otherwise(text('"', F.col("p_type"), '"')), '},{"assignee_organization":"third"}]')
    one = lambda i: text('{"patent_number":', F.when((key % 6 == 0) & F.lit(i == 1), "null").otherwise(text('"', 10 * key + i, '"')), ',"patent_title":"",', owners, "}")
    json = text('{"chembl_id":"CHEMBL:', key, '","patents":[', one(0), ",", one(1), ",", one(2), ",", one(3), "]}")
    pages = landed(dealt_rows(spark, sf_dir, "part", "p_partkey"), json, P.PATENTS)
    return P.patent_rows(pages, parts=tasks(spark, sf_dir, "part"))["edge"].select("src_cid", "type", "dst_cid")


def mesh_rows(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 9 == 0, " ").otherwise(F.col("c_name"))
    terms = text("<Term><String> Seg ", F.col("c_mktsegment"), "</String></Term><Term><String>seg ", F.lower("c_mktsegment"), "</String></Term><Term><String>", F.col("c_name"), "</String></Term><Term><String>n", F.col("c_nationkey"), "</String></Term>")
    tree = text("<TreeNumber>", F.when(key % 2 == 0, "C").otherwise("A"), key % 20, ".1</TreeNumber>")
    xml = text("<DescriptorRecord><DescriptorUI>D", key, "</DescriptorUI><DescriptorName><String>", name, "</String></DescriptorName><TreeNumberList>", tree, "</TreeNumberList><ConceptList><Concept><TermList>", terms, "</TermList></Concept></ConceptList></DescriptorRecord>")
    # Each text is parsed once, in tasks of PAYLOADS at most.
    return P.descriptors(dealt_rows(spark, sf_dir, "customer", "c_custkey").select(F.inline(F.array(F.from_xml(xml, P.DESCRIPTOR)))))


@query("SELECT 'D' || c_custkey AS ui, 'Seg ' || c_mktsegment AS alias FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT 'D' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_custkey % 9 <> 0")
def load_mesh_aliases(spark, sf_dir):
    return P.mesh_tables(mesh_rows(spark, sf_dir))["mesh_alias"]


PROMOTED = "promoted AS (SELECT * FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 2 = 0 AND c_custkey IN (SELECT s_suppkey FROM supplier))"


@query(f"WITH {PROMOTED} SELECT 'MESH:D' || c_custkey AS canonical_id, unnest(['Seg ' || c_mktsegment, 'seg ' || lower(c_mktsegment), 'n' || c_nationkey]) AS alias FROM promoted")
def load_promoted_aliases(spark, sf_dir):
    wanted = star.read(spark, sf_dir, "supplier").select(text("D", F.col("s_suppkey")).alias("mesh_id"))
    return P.promoted_diseases(mesh_rows(spark, sf_dir), wanted)[1].select("canonical_id", "alias")


@query(f"WITH {PROMOTED}, l AS (SELECT lower(c_name) AS label, c_custkey AS id FROM promoted UNION ALL SELECT lower(unnest(['Seg ' || c_mktsegment, 'n' || c_nationkey])), c_custkey FROM promoted) SELECT label, min(id) AS id FROM l GROUP BY label")
def label_lookup_aliases(spark, sf_dir):
    entity, alias = P.promoted_diseases(mesh_rows(spark, sf_dir), star.read(spark, sf_dir, "supplier").select(text("D", F.col("s_suppkey")).alias("mesh_id")))
    number = F.regexp_extract("canonical_id", "(\\d+)$", 1).cast("long").alias("id")
    return G.label_lookup(entity.select("name", number), alias.select("alias", number))


@query("SELECT 'ISS_' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS issuer_id, n_name || ', ' || s_nationkey AS universe_id, make_date(2000 + s_suppkey % 20, 1 + s_suppkey % 12, 1 + s_suppkey % 28) AS start_date FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def load_membership_seed(spark, sf_dir):
    key = F.col("s_suppkey")
    nation = F.broadcast(star.read(spark, sf_dir, "nation"))
    line = text("ISS_", F.lpad(key.cast("string"), 10, "0"), ',"', F.col("n_name"), ", ", F.col("s_nationkey"), '",', 1 + key % 12, "/", 1 + key % 28, "/", 2000 + key % 20)
    rows = star.read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return P.seed_rows(rows.select(F.from_csv(line, P.CSV["universe_membership"]).alias("r")).select("r.*"), "universe_membership")


def universe_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """membership (suppliers of lines, by return flag), issuers (half of the suppliers) and companies (customers)."""
    issuer, cik = lambda c: text("ISS_", c), lambda c: text("CIK_", F.lpad(c.cast("string"), 10, "0"))
    membership = star.read(spark, sf_dir, "lineitem").select(issuer(F.col("l_suppkey")).alias("issuer_id"), F.col("l_returnflag").alias("universe_id")).distinct()
    issuers = star.read(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(issuer(F.col("s_suppkey")).alias("issuer_id"), cik(3 * F.col("s_suppkey")).alias("primary_cik"))
    return membership, issuers, star.read(spark, sf_dir, "customer").select(cik(F.col("c_custkey")).alias("cik"), F.col("c_name").alias("sec_legal_name"))


@query("SELECT DISTINCT 'ISS_' || l_suppkey AS issuer_id, l_returnflag AS universe_id, 'CIK_' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS sec_legal_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON c_custkey = 3 * s_suppkey WHERE s_acctbal >= 0")
def universe_companies(spark, sf_dir):
    return P.universe_companies(*universe_tables(spark, sf_dir))


@query("SELECT DISTINCT 'ISS_' || l_suppkey AS issuer_id, l_returnflag AS universe_id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def members_without_issuer(spark, sf_dir):
    membership, issuers, _ = universe_tables(spark, sf_dir)
    return P.members_without_issuer(membership, issuers)


@query("SELECT 'CIK_' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN s_suppkey IS NOT NULL THEN 'Q' || s_suppkey END AS qid FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def qid_by_cik(spark, sf_dir):
    key = F.col("s_suppkey")
    found = star.read(spark, sf_dir, "supplier")
    # A company may be found twice; the first identifier counts.
    hits = found.select(key.cast("string").alias("cik"), text("Q", key).alias("qid")).unionByName(found.select(F.lpad(key.cast("string"), 10, "0").alias("cik"), text("Q", key, "x").alias("qid")))
    return P.qid_by_cik(star.read(spark, sf_dir, "customer").select(text("CIK_", F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("cik")), hits)


@query("SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS mesh_ui FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def therapy_area(spark, sf_dir):
    mapping = star.read(spark, sf_dir, "nation").join(star.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("mesh_id"), F.col("r_name").alias("therapy_area"))
    return P.by_therapy_area(star.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("mesh_ui")), mapping, "ASIA")


@query(f"WITH {ENTITY} SELECT CAST(to_json({{'id': id, 'name': name, 'kind': kind}}) AS VARCHAR) AS json FROM entity WHERE kind <> 'trial'")
def nodes_json(spark, sf_dir):
    return Q.as_json(entities(spark, sf_dir, "disease", "target", "drug", "company").select("id", "name", "kind"))


@query(f"""WITH {ENTITY} SELECT id, CASE kind WHEN 'disease' THEN '#e74c3c' WHEN 'target' THEN '#3498db' WHEN 'drug' THEN '#2ecc71' WHEN 'company' THEN '#f39c12' ELSE '#95a5a6' END AS color,
CASE kind WHEN 'disease' THEN 'diamond' WHEN 'drug' THEN 'box' WHEN 'company' THEN 'box' ELSE 'dot' END AS shape, CAST(CASE kind WHEN 'disease' THEN 35 WHEN 'drug' THEN 30 WHEN 'company' THEN 25 ELSE 20 END AS INTEGER) AS size FROM entity""")
def node_style(spark, sf_dir):
    return entities(spark, sf_dir).select("id", S.node_style(F.col("kind")).alias("style")).select("id", "style.*")


TOKENS = "tokens AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS token, id FROM entity WHERE kind IN ('drug', 'company'))"


@query(f"WITH {ENTITY}, {TOKENS} SELECT token, count(*) AS names FROM tokens GROUP BY token")
def token_index(spark, sf_dir):
    return Q.token_index(entities(spark, sf_dir, "drug", "company")).groupBy("token").agg(F.count("*").alias("names"))


@query(f"WITH {ENTITY}, {TOKENS} SELECT id FROM tokens WHERE token IN ('large', 'widget') GROUP BY id HAVING count(*) = 2 ORDER BY id LIMIT 20")
def search_tokens(spark, sf_dir):
    return Q.search_tokens(Q.token_index(entities(spark, sf_dir, "drug", "company")), "Widget, LARGE")
