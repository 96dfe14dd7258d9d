import gzip
import json

import pytest
from pyspark.sql import functions as F

from strandgraph.operators.store import Store
from strandgraph.plans import pipeline
from strandgraph.sources import payloads

RECORD = "<DescriptorRecord><DescriptorUI>{ui}</DescriptorUI><DescriptorName><String>{name}</String></DescriptorName><TreeNumberList>{trees}</TreeNumberList><ConceptList><Concept><TermList>{terms}</TermList></Concept></ConceptList></DescriptorRecord>"


def record(ui, name, trees, terms):
    return RECORD.format(ui=ui, name=name, trees="".join(f"<TreeNumber>{t}</TreeNumber>" for t in trees), terms="".join(f"<Term><String>{t}</String></Term>" for t in terms))


def study(nct, title, sponsor, conditions, interventions, phases=("PHASE1", "PHASE2"), updated="2024-05-01"):
    return {
        "protocolSection": {
            "identificationModule": {"nctId": nct, "officialTitle": title, "briefTitle": "brief"},
            "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2024-03"}},
            "designModule": {"studyType": "INTERVENTIONAL", "phases": list(phases)},
            "sponsorCollaboratorsModule": {"leadSponsor": {"name": sponsor}},
            "conditionsModule": {"conditions": conditions},
            "armsInterventionsModule": {"interventions": [{"type": t, "name": n} for t, n in interventions]},
        },
        "derivedSection": {"miscInfoModule": {"lastUpdatePostDateStruct": {"date": updated}}} if updated else {},
    }


@pytest.fixture
def landed(tmp_path):
    xml = "<DescriptorRecordSet>" + record("D1", "Asthma", ["C08.1"], ["Foo", "foo", "FOO", "Asthma"]) + record("D2", "Other", ["C01.2"], ["x"]) + record("D3", "Cell", ["A11"], []) + record("D4", "", ["C1"], []) + "</DescriptorRecordSet>"
    with gzip.open(tmp_path / "desc.xml.gz", "wt") as f:
        f.write(xml)
    (tmp_path / "ta.csv").write_text("﻿disease_name,mesh_id,efo_id,therapy_area\r\n\"Asthma, all\",D1,E1,Immunology\r\nCell,D3,E3,Other\r\n", encoding="utf-8")
    page = {"studies": [study("N1", "First", "Eli & Co.", ["ASTHMA", "nothing"], [("drug", "Drug A"), ("DEVICE", "D"), ("Biological", "")]), study("N1", "Last", "Eli & Co.", ["foo"], [], updated=None), study("", "none", "x", [], [])], "nextPageToken": "t"}
    (tmp_path / "trials.json").write_text(json.dumps(page))
    rows = [{"target": {"id": "E1", "approvedSymbol": "S", "approvedName": ""}, "score": 0.5}, {"target": {"id": "E2", "approvedSymbol": ""}, "score": 1}, {"target": {"id": "E3", "approvedSymbol": "T", "approvedName": "Tee"}}]
    pages = [{"mesh_id": "D1", "data": {"disease": {"id": "x", "associatedTargets": {"count": 3, "rows": rows}}}}, {"mesh_id": "D9", "data": {"disease": {"associatedTargets": {"rows": rows}}}}, {"mesh_id": "D1", "errors": [{"message": "bad"}]}]
    (tmp_path / "assoc.json").write_text("\n".join(map(json.dumps, pages)))
    found = {"chembl_id": "CHEMBL1", "patents": [{"patent_number": "9", "patent_title": "", "assignees": [{"assignee_organization": "Acme  Bio"}, {"assignee_organization": None}, {"assignee_organization": "third"}]}, {"patent_number": None}]}
    (tmp_path / "patents.json").write_text(json.dumps(found))
    return {"mesh": f"{tmp_path}/desc.xml.gz", "ta_mapping": f"{tmp_path}/ta.csv", "trials": f"{tmp_path}/trials.json", "associations": f"{tmp_path}/assoc.json", "patents": f"{tmp_path}/patents.json", "root": f"file://{tmp_path}/store"}


def test_mesh(spark, landed):
    records = payloads.mesh_records(spark, landed["mesh"], 2)
    assert sorted(r["ui"] for r in records.collect()) == ["D1", "D2", "D3"]
    tables = payloads.mesh_tables(records)
    assert [tuple(r) for r in tables["mesh_alias"].where("ui = 'D1'").collect()] == [("D1", "Foo")]
    entity, alias = payloads.promoted_diseases(records, payloads.seed(spark, "ta_mapping", landed["ta_mapping"]))
    assert [r["canonical_id"] for r in entity.collect()] == ["MESH:D1"]
    assert alias.count() == 3


def test_studies(spark, landed):
    rows = payloads.studies(spark, landed["trials"]).orderBy("title").collect()
    assert [(r["nct_id"], r["title"], r["phase_raw"], r["phase_max"], str(r["start_date"])) for r in rows] == [("N1", "First", "PHASE1,PHASE2", 2, "2024-03-01"), ("N1", "Last", "PHASE1,PHASE2", 2, "2024-03-01")]
    window = payloads.studies(spark, landed["trials"]).where(payloads.in_window(F.col("last_update_posted"), "2025-01-01", None))
    assert [r["title"] for r in window.collect()] == ["Last"]


def test_phases_as_plain_text_and_stripped_fields(spark, tmp_path):
    one = study("N2", " Title ", "x", [], [])
    one["protocolSection"]["designModule"] = {"studyType": " T ", "phases": "PHASE4"}
    two = study("N3", "t", "x", [], [], phases=())
    (tmp_path / "p.json").write_text(json.dumps({"studies": [one, two]}))
    rows = payloads.studies(spark, f"{tmp_path}/p.json").orderBy("nct_id").collect()
    assert [(r["title"], r["study_type"], r["phase_raw"], r["phase_max"]) for r in rows] == [("Title", "T", "PHASE4", 4), ("t", "INTERVENTIONAL", None, None)]


def test_associations_targets_and_patents(spark, landed, tmp_path):
    rows = payloads.associations(spark, landed["associations"]).where("mesh_id = 'D1'").orderBy("canonical_id").collect()
    assert [(r["canonical_id"], r["name"], r["score"]) for r in rows] == [("OPENTARGETS:E1", "S", 0.5), ("OPENTARGETS:E3", "Tee", 0.0)]
    listed = {"results": [{"target_chembl_id": "C1", "pref_name": "one", "cross_references": [{"xref_id": "D1", "xref_src": "MeSH"}]}, {"target_chembl_id": "C2", "pref_name": None, "cross_references": []}, {"target_chembl_id": "C3", "pref_name": "three"}]}
    (tmp_path / "targets.json").write_text(json.dumps(listed))
    assert [r["name"] for r in payloads.targets(spark, f"{tmp_path}/targets.json", ["D1"]).collect()] == ["one"]
    assert payloads.targets(spark, f"{tmp_path}/targets.json").count() == 2
    made = payloads.patents(spark, landed["patents"])
    assert {tuple(r) for r in made["entity"].collect()} == {("patent", "PATENT:9", "9"), ("company", "ORG:ACME_BIO", "Acme  Bio")}
    assert made["edge"].count() == 2


def test_enrichment_and_seed(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"ticker": "LLY", "results": {"bindings": [{"company": {"value": "http://w/entity/Q1"}, "founded": {"value": "1876"}}, {"company": {"value": "http://w/entity/Q2"}}]}}))
    assert payloads.enrichment(spark, f"{tmp_path}/e.json").select("wikidata_id", "founded", "website").first() == ("Q1", "1876", None)
    (tmp_path / "u.csv").write_text("﻿issuer_id,universe_id,start_date\r\nISS_1,IBB,3/9/2020\r\n", encoding="utf-8")
    assert str(payloads.seed(spark, "universe_membership", f"{tmp_path}/u.csv").first()["start_date"]) == "2020-03-09"


def test_pipeline_is_idempotent(spark, landed):
    store = Store(spark, landed["root"])
    once = pipeline.run(store, landed)
    assert pipeline.run(store, landed) == once
    assert once["trial"] == 1 and store.read("trial").first()["title"] == "Last"
    edges = {(r["type"], r["dst_cid"]) for r in store.read("edge").collect()}
    assert edges == {("associated_with", "OPENTARGETS:E1"), ("associated_with", "OPENTARGETS:E3"), ("sponsored_by", "CTG_SPONSOR:eli_and_co"), ("for_condition", "MESH:D1"), ("studies", "CTG_INT:drug_a"), ("protected_by", "PATENT:9"), ("assigned_to", "ORG:ACME_BIO")}
    with pytest.raises(ValueError):
        pipeline.run(store, landed, ["nothing"])


def test_company_lookups(spark, tmp_path):
    (tmp_path / "c.json").write_text("\n".join(json.dumps({"ticker": t, "response": r}) for t, r in (("LLY", "<CIK>59478</CIK>"), ("XX", "<none/>"))))
    found = payloads.cik_lookups(spark, f"{tmp_path}/c.json")
    assert [tuple(r) for r in found.collect()] == [("LLY", "0000059478")]
    landed = spark.createDataFrame([("59478", "Q2"), ("0000059478", "Q1"), ("x", "Q9")], "cik string, qid string")
    companies = spark.createDataFrame([("CIK_0000059478",), ("CIK_0000000001",)], "cik string")
    assert {r["cik"]: r["qid"] for r in payloads.qid_by_cik(companies, landed).collect()} == {"CIK_0000059478": "Q1", "CIK_0000000001": None}


def test_therapy_area(spark, landed):
    mapping = payloads.seed(spark, "ta_mapping", landed["ta_mapping"])
    entities = spark.createDataFrame([("D1", "a"), ("D3", "b"), (None, "c")], "mesh_ui string, name string")
    assert [r["name"] for r in payloads.by_therapy_area(entities, mapping, "Immunology").collect()] == ["a"]
