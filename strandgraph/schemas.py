"""Table schemas of the knowledge graph, and its vocabularies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Kinds of entities, with the code that leads their numeric ids in the star mapping.
KINDS = {"disease": 1, "target": 2, "drug": 3, "company": 4, "trial": 5, "patent": 6}
EDGE_TYPES = ["associated_with", "inhibits", "manufactured_by", "sponsored_by", "studies", "for_condition", "protected_by", "assigned_to"]

TABLES = {
    "entity": "kind string, canonical_id string, id long, name string, source string, mesh_ui string, props string, created_at timestamp, updated_at timestamp",
    "alias": "kind string, canonical_id string, alias string, source string",
    "edge": "src_kind string, src_cid string, dst_kind string, dst_cid string, src_id long, dst_id long, type string, source string, score double, props string, created_at timestamp",
    "mesh_descriptor": "ui string, name string",
    "mesh_tree": "ui string, tree_number string",
    "mesh_alias": "ui string, alias string",
    "trial": "nct_id string, title string, overall_status string, phase_raw string, phase_max int, study_type string, start_date date, primary_completion_date date, completion_date date, last_update_posted date, sponsor_name string",
    "patent": "patent_number string, publication_date date, title string, abstract string, cpc_codes array<string>, source string",
    "assignee": "name_raw string, name_norm string, country string, type string, lei string, cik string, wikidata_id string",
    "patent_assignee": "patent_number string, name_norm string, role string, sequence int",
    "patent_drug": "patent_number string, chembl_id string, link_type string",
    "license_allowlist": "license string, is_commercial_safe boolean, notes string",
    "evidence": "evidence_id string, source_system string, source_record_id string, evidence_type string, license string, url string, snippet string, checksum string, observed_at timestamp",
    "assertion": "assertion_id string, assertion_type string, subject_entity_id long, predicate string, object_entity_id long, confidence string, effective_from date, effective_to date, metadata string",
    "assertion_evidence": "assertion_id string, evidence_id string",
    "lookup_cache": "cache_key string, source string, value_json string, expires_at timestamp",
}

#: Natural keys, checked at write time.
KEYS = {
    "entity": ["kind", "canonical_id"],
    "alias": ["kind", "canonical_id", "alias"],
    "edge": ["src_kind", "src_cid", "type", "dst_kind", "dst_cid"],
    "mesh_descriptor": ["ui"],
    "mesh_tree": ["ui", "tree_number"],
    "mesh_alias": ["ui", "alias"],
    "trial": ["nct_id"],
    "patent": ["patent_number"],
    "assignee": ["name_norm"],
    "patent_assignee": ["patent_number", "name_norm", "sequence"],
    "patent_drug": ["patent_number", "chembl_id"],
    "license_allowlist": ["license"],
    "evidence": ["evidence_id"],
    "assertion": ["assertion_id"],
    "assertion_evidence": ["assertion_id", "evidence_id"],
    "lookup_cache": ["cache_key"],
}


class Link(NamedTuple):
    """A foreign key, and whether rows go with the row that they refer to."""

    child: str
    child_keys: tuple[str, ...]
    parent: str
    parent_keys: tuple[str, ...]
    cascade: bool = True


FOREIGN_KEYS = [
    Link("mesh_tree", ("ui",), "mesh_descriptor", ("ui",)),
    Link("mesh_alias", ("ui",), "mesh_descriptor", ("ui",)),
    Link("entity", ("mesh_ui",), "mesh_descriptor", ("ui",), cascade=False),
    Link("alias", ("kind", "canonical_id"), "entity", ("kind", "canonical_id")),
    Link("edge", ("src_kind", "src_cid"), "entity", ("kind", "canonical_id")),
    Link("edge", ("dst_kind", "dst_cid"), "entity", ("kind", "canonical_id")),
    Link("patent_assignee", ("patent_number",), "patent", ("patent_number",)),
    Link("patent_assignee", ("name_norm",), "assignee", ("name_norm",)),
    Link("patent_drug", ("patent_number",), "patent", ("patent_number",)),
    Link("evidence", ("license",), "license_allowlist", ("license",), cascade=False),
    Link("assertion", ("subject_entity_id",), "entity", ("id",)),
    Link("assertion", ("object_entity_id",), "entity", ("id",)),
    Link("assertion_evidence", ("assertion_id",), "assertion", ("assertion_id",)),
    Link("assertion_evidence", ("evidence_id",), "evidence", ("evidence_id",)),
]

#: What the store lays tables out by.
PARTITIONS = {"entity": ["kind"], "edge": ["type"]}

#: Licences and whether commercial use is safe.
LICENSES = [("CC0", True), ("CC-BY-4.0", True), ("ODbL", True), ("OGL-UK-3.0", True), ("MIT", True), ("Apache-2.0", True), ("PROPRIETARY", False), ("CC-BY-NC", False), ("ALL_RIGHTS_RESERVED", False)]


def struct(name: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def license_allowlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s, None) for n, s in LICENSES], TABLES["license_allowlist"])
