"""Evidence: licence gates, guards, validity and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import ConstraintError


def violations(evidence: DataFrame, licenses: DataFrame) -> DataFrame:
    """Evidence whose licence is unknown, missing or not safe now. The list of licences is a small table of its own."""
    joined = evidence.join(licenses.select("license", "is_commercial_safe"), "license", "left")
    return joined.where(~F.coalesce("is_commercial_safe", F.lit(False)))


def accepted(batch: DataFrame, licenses: DataFrame) -> DataFrame:
    """The rows of a batch whose licence is safe."""
    return batch.join(licenses.where("is_commercial_safe").select("license"), "license", "left_semi")


def gate(batch: DataFrame, licenses: DataFrame) -> DataFrame:
    """The batch, or an error if any row's licence is not safe: the whole batch fails."""
    if batch.join(licenses.where("is_commercial_safe").select("license"), "license", "left_anti").take(1):
        raise ConstraintError("a licence is not on the safe list")
    return batch


def seed_is_sane(licenses: DataFrame, least: int = 5) -> bool:
    return licenses.where("is_commercial_safe").limit(least).count() >= least


def unsupported(assertions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Assertions without evidence."""
    return assertions.join(bridge.select("assertion_id"), "assertion_id", "left_anti")


def supported(assertions: DataFrame, bridge: DataFrame, evidence: DataFrame) -> DataFrame:
    """Assertions with each piece of their evidence."""
    return assertions.join(bridge, "assertion_id").join(evidence, "evidence_id")


def news_only(assertions: DataFrame, bridge: DataFrame, evidence: DataFrame, kind: str = "news") -> DataFrame:
    """assertion_id of assertions all of whose evidence is of one kind."""
    return supported(assertions, bridge, evidence).groupBy("assertion_id").agg(F.bool_and(F.col("evidence_type") == kind).alias("only")).where("only").select("assertion_id")


def as_of(assertions: DataFrame, day: Column) -> DataFrame:
    """Assertions valid on a day: from effective_from on, up to but without effective_to; an open end is still valid."""
    return assertions.where((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (day < F.col("effective_to"))))


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Unexpired entries; one that expires just now is still live."""
    return cache.where(F.col("expires_at") >= now)


def distinct_content(evidence: DataFrame, order: str = "evidence_id") -> DataFrame:
    """One row a checksum, the first by order. Narrow rows are compared, the rest is joined."""
    first = evidence.groupBy("checksum").agg(F.min(order).alias(order))
    return evidence.join(first, ["checksum", order], "left_semi")


def label_of(ids: DataFrame, cache: DataFrame, landed: DataFrame, now: Column) -> DataFrame:
    """qid and label: the unexpired cache's, else the landed lookup's, else Wikidata:<qid>."""
    hit = live(cache, now).select(F.col("cache_key").alias("qid"), F.get_json_object("value_json", "$.label").alias("hit"))
    return ids.join(hit, "qid", "left").join(landed.select("qid", F.col("label").alias("found")), "qid", "left").select("qid", F.coalesce("hit", "found", F.concat(F.lit("Wikidata:"), "qid")).alias("label"))
