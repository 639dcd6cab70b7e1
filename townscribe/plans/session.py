"""The session that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "townscribe", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` override, a cluster's own settings stay."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()
