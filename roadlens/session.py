"""A session with the settings that results depend on, and those that plans profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC and ANSI decide results; adaptive execution picks joins and partition counts at run time."""
    builder = SparkSession.builder.appName("roadlens")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()
