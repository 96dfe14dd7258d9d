"""Loaders of landed payloads: ontology XML, trial, association, target, patent and enrichment JSON, seed CSV.

Live services page serially; their responses are landed as files (one page each) and read here in parallel with declared
schemas. Only the fields in use are parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.staging import dealt

DESCRIPTOR = "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>, ConceptList struct<Concept:array<struct<TermList:struct<Term:array<struct<String:string>>>>>>"
DAY = "struct<date:string>"
STUDY = (
    "struct<protocolSection:struct<identificationModule:struct<nctId:string,officialTitle:string,briefTitle:string>,"
    f"statusModule:struct<overallStatus:string,startDateStruct:{DAY},primaryCompletionDateStruct:{DAY},completionDateStruct:{DAY}>,"
    "designModule:struct<studyType:string,phases:string>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,"
    "sponsorsCollaboratorsModule:struct<leadSponsor:struct<name:string>>,conditionsModule:struct<conditions:array<string>>,"
    "armsInterventionsModule:struct<interventions:array<struct<type:string,name:string>>>>,"
    f"derivedSection:struct<miscInfoModule:struct<lastUpdatePostDateStruct:{DAY}>>>"
)
ASSOCIATIONS = "data struct<disease:struct<id:string,name:string,associatedTargets:struct<count:long,rows:array<struct<target:struct<id:string,approvedSymbol:string,approvedName:string>,score:double>>>>>, errors array<struct<message:string>>, mesh_id string"
TARGETS = "results array<struct<target_chembl_id:string,pref_name:string,cross_references:array<struct<xref_id:string,xref_src:string>>>>"
PATENTS = "chembl_id string, patents array<struct<patent_number:string,patent_title:string,patent_date:string,assignees:array<struct<assignee_organization:string>>>>"
VALUE = "struct<value:string>"
BINDINGS = "results struct<bindings:array<struct<" + ",".join(f"{n}:{VALUE}" for n in ("company", "founded", "hqLabel", "countryLabel", "website", "employees", "revenue", "ticker")) + ">>>, ticker string"

CSV = {
    "company": "cik string, sec_legal_name string, ticker string, exchange string",
    "issuer": "issuer_id string, primary_cik string",
    "universe_membership": "issuer_id string, universe_id string, start_date string",
    "ta_mapping": "disease_name string, mesh_id string, efo_id string, therapy_area string",
}


def mesh_records(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """ui, name, trees, terms (as listed, stripped, without empty ones) of each complete record. A gzip file is one split, so its
    records are dealt out before they are worked on."""
    raw = spark.read.option("rowTag", "DescriptorRecord").schema(DESCRIPTOR).xml(path)
    return descriptors(raw.repartition(partitions) if partitions else raw)


def descriptors(raw: DataFrame) -> DataFrame:
    """The records of parsed descriptors (the fields of DESCRIPTOR)."""
    concepts = F.coalesce("ConceptList.Concept", F.array())
    terms = F.flatten(F.transform(concepts, lambda c: F.coalesce(F.transform(c["TermList"]["Term"], lambda t: S.strip(t["String"])), F.array())))
    out = raw.select(S.strip(F.col("DescriptorUI")).alias("ui"), S.strip(F.col("DescriptorName.String")).alias("name"), F.filter(F.coalesce(F.transform("TreeNumberList.TreeNumber", S.strip), F.array()), lambda x: x != "").alias("trees"), terms.alias("terms"))
    return out.where(S.present(F.col("ui"), F.col("name"))).withColumn("terms", F.filter("terms", lambda t: (t != "") & (t != F.col("name"))))


def mesh_tables(records: DataFrame) -> dict[str, DataFrame]:
    """mesh_descriptor, mesh_tree, and mesh_alias with the first spelling of each term, case aside."""
    first = records.select("ui", F.posexplode("terms").alias("pos", "alias")).groupBy("ui", F.lower("alias").alias("k")).agg(F.min(F.struct("pos", "alias")).alias("one"))
    return {
        "mesh_descriptor": records.groupBy("ui").agg(F.max("name").alias("name")),
        "mesh_tree": records.select("ui", F.explode("trees").alias("tree_number")).distinct(),
        "mesh_alias": first.select("ui", F.col("one.alias").alias("alias")),
    }


def promoted_diseases(records: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Disease entities and their aliases: a tree number under C, and a ui among the wanted (mesh_id)."""
    kept = records.where(F.exists("trees", lambda t: t.startswith("C"))).join(wanted.select(F.col("mesh_id").alias("ui")).distinct(), "ui", "left_semi")
    cid = F.concat(F.lit("MESH:"), "ui")
    entity = kept.select(F.lit("disease").alias("kind"), cid.alias("canonical_id"), "name", F.col("ui").alias("mesh_ui"))
    alias = kept.select(F.lit("disease").alias("kind"), cid.alias("canonical_id"), F.explode("terms").alias("alias"), F.lit("mesh").alias("source")).distinct()
    return entity, alias


def studies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """study_rows of landed pages; batch_seq is page file and place in the page."""
    page = spark.read.schema(f"studies array<{STUDY}>, nextPageToken string").option("multiLine", True).json(path)
    s = page.select(F.input_file_name().alias("page"), F.posexplode("studies").alias("pos", "s"))
    return study_rows(s.select(F.struct("page", "pos").alias("batch_seq"), "s"))


def paged_studies(spark: SparkSession, path: str) -> DataFrame:
    """study_rows of a landing of token chains (see sources.paging); batch_seq is query, page and place in the page."""
    from .paging import pages

    found = pages(spark, path).select("query", "page", F.from_json("body", f"studies array<{STUDY}>").alias("p"))
    s = found.select("query", "page", F.posexplode("p.studies").alias("pos", "s"))
    return study_rows(s.select(F.struct("query", "page", "pos").alias("batch_seq"), "s"))


def paged_associations(spark: SparkSession, path: str) -> DataFrame:
    """associations of a landing of numbered pages; the query's name is the mesh_id."""
    from .paging import pages

    page = pages(spark, path).select("query", F.from_json("body", ASSOCIATIONS).alias("p")).select("p.data", "p.errors", F.col("query").alias("mesh_id"))
    return association_rows(page)


def study_rows(s: DataFrame) -> DataFrame:
    """One row per study (batch_seq, s): the extracted fields, and batch_seq for last-wins writers. Studies without an
    identifier are dropped; phases may be a list or plain text."""
    p = "s.protocolSection"
    date = lambda c: S.parse_date(F.col(c))
    ident, status = f"{p}.identificationModule", f"{p}.statusModule"
    out = s.select(
        "batch_seq",
        S.strip(F.col(f"{ident}.nctId")).alias("nct_id"),
        S.strip(S.first_filled(F.col(f"{ident}.officialTitle"), F.col(f"{ident}.briefTitle"))).alias("title"),
        S.strip(F.col(f"{status}.overallStatus")).alias("overall_status"),
        S.phase_text(F.col(f"{p}.designModule.phases")).alias("phase_raw"),
        S.strip(F.col(f"{p}.designModule.studyType")).alias("study_type"),
        date(f"{status}.startDateStruct.date").alias("start_date"),
        date(f"{status}.primaryCompletionDateStruct.date").alias("primary_completion_date"),
        date(f"{status}.completionDateStruct.date").alias("completion_date"),
        date("s.derivedSection.miscInfoModule.lastUpdatePostDateStruct.date").alias("last_update_posted"),
        S.blank_to_null(S.strip(F.coalesce(f"{p}.sponsorCollaboratorsModule.leadSponsor.name", f"{p}.sponsorsCollaboratorsModule.leadSponsor.name"))).alias("sponsor_name"),
        F.filter(F.coalesce(F.transform(f"{p}.conditionsModule.conditions", S.strip), F.array()), lambda x: x != "").alias("conditions"),
        F.coalesce(f"{p}.armsInterventionsModule.interventions", F.array()).alias("interventions"),
    )
    return out.where(S.present(F.col("nct_id"))).withColumn("phase_max", S.phase_max(F.col("phase_raw")))


def in_window(day: Column, lo: str | None = None, hi: str | None = None) -> Column:
    """Inclusive window of dates; null passes, either bound may be open."""
    ok = F.lit(True)
    if lo:
        ok = ok & (day >= F.lit(lo).cast("date"))
    if hi:
        ok = ok & (day <= F.lit(hi).cast("date"))
    return day.isNull() | ok


def trial_graph(found: DataFrame, labels: DataFrame, parts: int | None = None) -> dict[str, DataFrame]:
    """Entities, trial rows and edges of studies; labels is (label, canonical_id), lower-case, one row a label. A study's edges of all types are
    made in one pass, so that it is parsed once; parts: partitions that edges are dealt over before they are made distinct, if shuffles have fewer."""
    trial = F.concat(F.lit("NCT:"), "nct_id")
    company = F.concat(F.lit("CTG_SPONSOR:"), S.slug(F.col("sponsor_name")))
    used = found.select("nct_id", F.explode("interventions").alias("i")).where(F.upper("i.type").isin("DRUG", "BIOLOGICAL")).select("nct_id", S.strip(F.col("i.name")).alias("name")).where(S.present(F.col("name")))
    drug = F.concat(F.lit("CTG_INT:"), S.slug(F.col("name")))
    sponsors = found.where("sponsor_name IS NOT NULL")
    end = lambda kind, dst_kind, dst, label: F.struct(F.lit(kind).alias("type"), F.lit(dst_kind).alias("dst_kind"), dst.alias("dst_cid"), label.alias("label"))
    none = F.lit(None).cast("string")
    given = F.filter("interventions", lambda i: F.upper(i["type"]).isin("DRUG", "BIOLOGICAL") & S.present(S.strip(i["name"])))
    ends = F.concat(
        F.filter(F.array(end("sponsored_by", "company", company, none)), lambda e: e["dst_cid"].isNotNull()),
        F.transform("conditions", lambda c: end("for_condition", "disease", none, F.lower(c))),
        F.transform(given, lambda i: end("studies", "drug", F.concat(F.lit("CTG_INT:"), S.slug(S.strip(i["name"]))), none)),
    )
    # Only a condition has a label, and its end is the label's entity.
    ended = found.select(F.lit("trial").alias("src_kind"), trial.alias("src_cid"), F.inline(ends)).join(labels.select("label", "canonical_id"), "label", "left")
    edges = ended.where("type <> 'for_condition' OR canonical_id IS NOT NULL").select("src_kind", "src_cid", "type", "dst_kind", F.coalesce("dst_cid", "canonical_id").alias("dst_cid"))
    return {
        "entity": found.select(F.lit("trial").alias("kind"), trial.alias("canonical_id"), F.coalesce("title", "nct_id").alias("name"))
        .unionByName(sponsors.select(F.lit("company").alias("kind"), company.alias("canonical_id"), F.col("sponsor_name").alias("name")))
        .unionByName(used.select(F.lit("drug").alias("kind"), drug.alias("canonical_id"), "name")),
        "trial": found.drop("conditions", "interventions"),
        "edge": dealt(edges, parts, "src_cid").distinct(),
    }


def associations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """mesh_id, target canonical_id, name, score, props; pages with errors or no data give none."""
    return association_rows(spark.read.schema(ASSOCIATIONS).json(path))


def association_rows(page: DataFrame) -> DataFrame:
    """associations of parsed pages."""
    r = page.where("errors IS NULL OR size(errors) = 0").select("mesh_id", F.explode("data.disease.associatedTargets.rows").alias("r"))
    kept = r.where(S.present(F.col("r.target.id"), F.col("r.target.approvedSymbol"))).withColumn("score", F.coalesce("r.score", F.lit(0.0)))
    return kept.select("mesh_id", F.concat(F.lit("OPENTARGETS:"), "r.target.id").alias("canonical_id"), S.first_filled(F.col("r.target.approvedName"), F.col("r.target.approvedSymbol")).alias("name"), "score", S.edge_props(F.col("score"), F.col("mesh_id")).alias("props"))


def targets(spark: SparkSession, path: str | list[str], mesh_ids: list[str] | None = None) -> DataFrame:
    """canonical_id and name of a target list, those with a cross reference into mesh_ids if given. Null names are dropped."""
    return target_rows(spark.read.schema(TARGETS).option("multiLine", True).json(path), mesh_ids)


def target_rows(page: DataFrame, mesh_ids: list[str] | None = None) -> DataFrame:
    """targets of parsed pages."""
    t = page.select(F.explode("results").alias("t")).select("t.*")
    if mesh_ids is not None:
        t = t.where(F.coalesce(F.exists("cross_references", lambda r: (r["xref_src"] == "MeSH") & r["xref_id"].isin(mesh_ids)), F.lit(False)))
    return t.where(S.present(F.col("target_chembl_id"), F.col("pref_name"))).select(F.concat(F.lit("CHEMBL:"), "target_chembl_id").alias("canonical_id"), F.col("pref_name").alias("name"))


def patents(spark: SparkSession, path: str | list[str], per_drug: int = 3, assignees: int = 2) -> dict[str, DataFrame]:
    """Entities and edges of patent searches by drug: the first patents, and each one's first named assignees."""
    return patent_rows(spark.read.schema(PATENTS).json(path), per_drug, assignees)


def patent_rows(page: DataFrame, per_drug: int = 3, assignees: int = 2, parts: int | None = None) -> dict[str, DataFrame]:
    """patents of parsed pages; parts: partitions that edges are dealt over before they are made distinct, if shuffles have fewer."""
    p = page.select("chembl_id", F.explode(F.slice("patents", 1, per_drug)).alias("p")).where(S.present(F.col("p.patent_number")))
    number = F.concat(F.lit("PATENT:"), "p.patent_number")
    owners = p.select(number.alias("cid"), F.explode(F.slice("p.assignees", 1, assignees)).alias("a")).select("cid", F.col("a.assignee_organization").alias("org")).where(S.present(F.col("org")))
    title = F.substring(S.first_filled(F.col("p.patent_title"), F.col("p.patent_number"), F.lit("Unknown patent")), 1, 255)
    edge = lambda kind, sk, s, dk, d: (F.lit(sk).alias("src_kind"), s.alias("src_cid"), F.lit(kind).alias("type"), F.lit(dk).alias("dst_kind"), d.alias("dst_cid"))
    edges = p.select(*edge("protected_by", "drug", F.col("chembl_id"), "patent", number)).unionByName(owners.select(*edge("assigned_to", "patent", F.col("cid"), "company", S.org_key(F.col("org")))))
    return {
        "entity": p.select(F.lit("patent").alias("kind"), number.alias("canonical_id"), title.alias("name")).unionByName(owners.select(F.lit("company").alias("kind"), S.org_key(F.col("org")).alias("canonical_id"), F.substring("org", 1, 255).alias("name"))).dropDuplicates(["kind", "canonical_id"]),
        "edge": dealt(edges, parts, "src_cid").distinct(),
    }


def enrichment(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per ticker of company lookups: the first binding's fields, null where it has none."""
    return enrichment_rows(spark.read.schema(BINDINGS).json(path))


def enrichment_rows(page: DataFrame) -> DataFrame:
    """enrichment of parsed pages."""
    b = page.select("ticker", F.get("results.bindings", F.lit(0)).alias("b"))
    return b.where("b IS NOT NULL").select("ticker", S.uri_tail(F.col("b.company.value")).alias("wikidata_id"), F.col("b.founded.value").alias("founded"), F.col("b.hqLabel.value").alias("headquarters"), F.col("b.countryLabel.value").alias("country"), F.col("b.website.value").alias("website"), F.col("b.employees.value").alias("employees"), F.col("b.revenue.value").alias("revenue"))


def cik_lookups(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ticker and padded CIK of landed company searches (ticker, response); responses without a CIK are dropped."""
    return cik_rows(spark.read.schema("ticker string, response string").json(path))


def cik_rows(page: DataFrame) -> DataFrame:
    """cik_lookups of parsed responses."""
    return page.select("ticker", S.cik_of(F.col("response")).alias("cik")).where("cik IS NOT NULL").dropDuplicates(["ticker"])


def qid_by_cik(companies: DataFrame, landed: DataFrame) -> DataFrame:
    """companies (cik, ...) with the first landed qid of their number; leading zeros and a prefix do not matter."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("long")
    first = landed.select(number(F.col("cik")).alias("_n"), "qid").groupBy("_n").agg(F.min("qid").alias("qid"))
    return companies.withColumn("_n", number(F.col("cik"))).join(first, "_n", "left").drop("_n")


def by_therapy_area(entities: DataFrame, mapping: DataFrame, area: str) -> DataFrame:
    """Entities whose mesh_ui belongs to a therapy area."""
    ids = mapping.where(F.col("therapy_area") == area).select(F.col("mesh_id").alias("mesh_ui")).distinct()
    return entities.join(ids, "mesh_ui", "left_semi")


def seed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A seed CSV with its declared schema; membership dates are M/d/yyyy."""
    return seed_rows(spark.read.option("header", True).option("encoding", "UTF-8").schema(CSV[name]).csv(path), name)


def seed_rows(df: DataFrame, name: str) -> DataFrame:
    """seed of parsed lines."""
    return df.withColumn("start_date", F.try_to_date("start_date", "M/d/yyyy")) if name == "universe_membership" else df


def target_ids(mapping: DataFrame) -> DataFrame:
    return mapping.select("mesh_id").where(S.present(F.col("mesh_id"))).distinct()


def universe_companies(membership: DataFrame, issuers: DataFrame, companies: DataFrame) -> DataFrame:
    """issuer_id, universe_id, cik and sec_legal_name of each member whose issuer, and the issuer's company, is there."""
    found = membership.select("issuer_id", "universe_id").join(issuers, "issuer_id")
    return found.join(companies.withColumnRenamed("cik", "primary_cik"), "primary_cik").select("issuer_id", "universe_id", F.col("primary_cik").alias("cik"), "sec_legal_name")


def members_without_issuer(membership: DataFrame, issuers: DataFrame) -> DataFrame:
    """Membership rows of issuers that have no row of their own."""
    return membership.join(issuers.select("issuer_id").distinct(), "issuer_id", "left_anti")
