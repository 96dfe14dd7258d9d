import datetime

import pytest
from pyspark.sql import functions as F

from strandgraph.functions import scalar as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, expected",
    [("Eli Lilly & Co., Inc. (US)", "eli_lilly_and_co_inc_us"), ("O'Neil/Smith", "oneil_smith"), ("()", ""), (" ".join("abcdefghijklmn"), "a_b_c_d_e_f_g_h_i_j_k_l"), ("X-Y", "x-y"), ("a b", "a_b")],
)
def test_slug(spark, text, expected):
    assert value(spark, S.slug(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("2024-03-05", (2024, 3, 5)), ("2024-3-5", (2024, 3, 5)), (" 2024-03 ", (2024, 3, 1)), ("2024", (2024, 1, 1)), ("2024-02-30", None), ("2024-03-05xyz", None), ("", None), (None, None), ("24", None)],
)
def test_parse_date(spark, text, expected):
    found = value(spark, S.parse_date(F.lit(text).cast("string")))
    assert found == (expected and datetime.date(*expected))


@pytest.mark.parametrize("phases, raw, highest", [(["PHASE1", "PHASE2"], "PHASE1,PHASE2", 2), (["EARLY_PHASE1"], "EARLY_PHASE1", 1), (["NA"], "NA", None), ([], None, None), (["phase4"], "phase4", 4)])
def test_phases(spark, phases, raw, highest):
    joined = S.phase_join(F.array(*(F.lit(p) for p in phases)) if phases else F.array().cast("array<string>"))
    assert value(spark, joined) == raw
    assert value(spark, S.phase_max(joined)) == highest


def test_org_key_cik_and_uri(spark):
    assert value(spark, S.org_key(F.lit("Acme\t Bio  Inc"))) == "ORG:ACME_BIO_INC"
    assert value(spark, S.cik_of(F.lit("<CIK>320193</CIK>"))) == "0000320193"
    assert value(spark, S.cik_of(F.lit("none"))) is None
    assert value(spark, S.uri_tail(F.lit("http://x/entity/Q42"))) == "Q42"


def test_json_merge_right_wins_with_nulls(spark):
    assert value(spark, S.json_merge(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":null,"c":"3"}'))) == {"a": "1", "b": None, "c": "3"}
    assert value(spark, S.json_merge(F.lit(None).cast("string"), F.lit('{"c":"3"}'))) == {"c": "3"}


@pytest.mark.parametrize("q, expected", [("ab", "%ab%"), ("a%_", "%a%_%"), ("\\_", "%\\_%"), ("\\b", "%b%"), ("a\\", "%a\\%")])
def test_like_pattern(q, expected):
    assert S.like_pattern(q) == expected
