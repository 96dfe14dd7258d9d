"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution; keyword names use underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
