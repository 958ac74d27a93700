"""A session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """Shuffle partitions and memory are left to the cluster (or to `more`): they depend on the input."""
    builder = SparkSession.builder.config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
