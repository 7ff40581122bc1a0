"""Rider profiles: free-form documents beside a key, and the check of a session's health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from roadlens.functions.scalars import json_contains
from roadlens.operators.counting import get
from pyspark.sql import functions as F


def profiles(table: DataFrame) -> DataFrame:
    return table


def profile(table: DataFrame, wanted: object) -> DataFrame:
    return get(table, wanted)


def containing(table: DataFrame, column: str = "metadata", **wanted: object) -> DataFrame:
    """Rows whose document holds the keys with just these values."""
    return table.filter(json_contains(F.col(column), **wanted))


def joined_left(table: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Across services: all rows of one table, with those of the other where there are any."""
    return table.join(other, table[key] == other[other_key], "left")


def health(spark: SparkSession, service: str = "roadlens", now: dt.datetime | None = None) -> dict[str, str]:
    """Whether a constant query runs: status ok or error, with the time and the state of the database."""
    stamp = (now or dt.datetime.now(dt.UTC)).isoformat()
    try:
        alive = spark.sql("SELECT 1 AS one").first()["one"] == 1
    except Exception:  # whatever keeps the query from running is what is asked for
        alive = False
    return {"status": "ok" if alive else "error", "timestamp": stamp, "service": service, "database": "connected" if alive else "disconnected"}
