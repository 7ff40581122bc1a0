"""Data quality: the constraints that the schema declares, as queries for what violates them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.plans.schemas import CHARACTERISTICS, CODED, DEATH_TEXT_LIMITS, DIRECTIONS
from roadlens.functions.scalars import json_int


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: rows that break each rule, all in one scan. A rule that is null counts as kept."""
    counts = df.agg(*[F.count_if(F.coalesce(~ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    listed = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])
    return counts.select(F.explode(listed).alias("r")).select("r.rule", "r.n")


def death_rules(columns: list[str]) -> dict[str, Column]:
    """Ages, domains, lengths and required fields, of the columns that are there."""
    rules = {f"{c} missing": F.col(c).isNotNull() for c in ("dtobito", "causabas")}
    rules["idade from 0 to 150"] = F.col("idade").between(0, 150)
    rules |= {f"{c} in {'/'.join(v)}": F.col(c).isin(*v) for c, v in CODED.items()}
    rules |= {f"{c} up to {n}": F.length(c) <= n for c, n in DEATH_TEXT_LIMITS.items()}
    return {name: ok for name, ok in rules.items() if name.split()[0] in columns}


def location_rules() -> dict[str, Column]:
    return {
        "latitude a degree": F.col("latitude").cast("double").between(-90, 90),
        "longitude a degree": F.col("longitude").cast("double").between(-180, 180),
        "name missing": F.length("name") > 0,
    }


def session_rules() -> dict[str, Column]:
    return {
        "characteristics not negative": reduce(lambda a, b: a & b, [F.coalesce(json_int(F.col("characteristics"), c), F.lit(0)) >= 0 for c in CHARACTERISTICS]),
        "total not negative": F.col("total_cyclists") >= 0,
    }


def movement_rules() -> dict[str, Column]:
    return {
        "from a direction": F.col("from_direction").isin(*DIRECTIONS),
        "to a direction": F.col("to_direction").isin(*DIRECTIONS),
        "from is not to": F.col("from_direction") != F.col("to_direction"),
        "count not negative": F.col("count") >= 0,
    }


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Rows whose parent is missing (rows without a key aside)."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col("id").alias("__id")), F.col(key) == F.col("__id"), "left_anti")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def uneven_totals(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events whose total is not the sum of their sessions."""
    summed = sessions.groupBy(F.col("event_id").alias("__event")).agg(F.sum("total_cyclists").cast("long").alias("sum_sessions"))
    joined = table.join(summed, F.col("id") == F.col("__event"), "left").drop("__event")
    return joined.filter(F.coalesce("sum_sessions", F.lit(0)) != F.col("total_cyclists"))
