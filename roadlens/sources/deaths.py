"""Loading mortality files: conversion, rejects, and an append that skips years that are already there."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadlens.functions.scalars import compact_date, leading_int
from roadlens.plans.schemas import DEATH_DATES, DEATH_INTS, EXTRA_DATES, EXTRA_INTS, TRAFFIC_DEATHS


#: Groups that the rows of a day are numbered in.
KEY_BUCKETS = 64


def batch_mark(now: dt.datetime | None = None) -> str:
    return "seed-" + (now or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")


def converted(raw: DataFrame, *, strict: bool = True, extras: bool = False) -> DataFrame:
    """Typed columns of a death record from text ones, with ``reject``: why a row can't be loaded, or null.

    Columns that the file lacks are null. ``strict`` wants dates of eight digits after trimming; otherwise
    any eight characters are tried. ``extras`` keeps the dates and numbers beside the schema. A year comes from
    ``file_year`` where there is one. A row without date or cause, or with an impossible date, is rejected by
    itself and takes no others with it.
    """

    def text(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    generated = {"id", "data_year", "import_batch", "created_at", "updated_at"}
    out = {}
    for f in TRAFFIC_DEATHS.fields:
        if f.name in DEATH_DATES:
            out[f.name] = compact_date(text(f.name), strict=strict)
        elif f.name in DEATH_INTS:
            out[f.name] = leading_int(text(f.name))
        elif f.name not in generated:
            out[f.name] = text(f.name)
    if extras:
        out |= {c: compact_date(text(c), strict=strict) for c in EXTRA_DATES} | {c: leading_int(text(c)) for c in EXTRA_INTS}
    reject = (
        F.when(text("dtobito").isNull(), F.lit("dtobito missing"))
        .when(text("causabas").isNull(), F.lit("causabas missing"))
        .when(compact_date(text("dtobito"), strict=strict).isNull(), F.lit("dtobito is no date"))
    )
    year = F.col("file_year") if "file_year" in raw.columns else F.lit(None).cast("int")
    return raw.select(*[c.alias(n) for n, c in out.items()], year.alias("data_year"), reject.alias("reject"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject").isNull()).drop("reject")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject").isNotNull())


def new_years(rows: DataFrame, loaded: DataFrame | None) -> DataFrame:
    """Rows of years of which nothing is loaded. The loaded years are a few values, whatever the table's size."""
    if loaded is None:
        return rows
    years = loaded.select(F.col("data_year").alias("__year")).distinct()
    return rows.join(years, F.col("data_year") == F.col("__year"), "left_anti")


def with_keys(rows: DataFrame, batch: str, start: int = 0) -> DataFrame:
    """The table's columns: ids from ``start`` + 1, the batch's mark and the times.

    Ids follow year and date. They are numbered within small groups, of a day and one of KEY_BUCKETS hashes of
    the row, and then shifted by the groups before: no task orders more than such a group, whatever a year
    holds. Equal rows take any order among each other.
    """
    key = ["data_year", "dtobito", "__bucket"]
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(KEY_BUCKETS)))
    per_group = dealt.groupBy(*key).agg(F.count("*").alias("__n"))
    # A row for each day and bucket, which does not grow with the rows.
    before = F.coalesce(F.sum("__n").over(W.orderBy(*key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = per_group.select(*[F.col(k).alias(f"{k}_") for k in key], before.alias("__before"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key])
    within = F.row_number().over(W.partitionBy(*key).orderBy("causabas", "contador", F.xxhash64(*rows.columns)))
    numbered = dealt.withColumn("__within", within).join(shifts, same)
    now = F.localtimestamp()
    named = numbered.withColumns({"id": (F.lit(start) + F.col("__before") + F.col("__within")).cast("int"), "import_batch": F.lit(batch), "created_at": now, "updated_at": now})
    return named.select(*TRAFFIC_DEATHS.names)


def write(rows: DataFrame, path: str, files_a_year: int = 8) -> None:
    """Appends by year, sorted within each file by city and cause, so that their statistics prune row groups.

    ``files_a_year`` is how many tasks a year is dealt to, by city: about its size over a few hundred MB.
    """
    laid_out = rows.repartition("data_year", F.pmod(F.xxhash64("codmunocor"), F.lit(files_a_year))).sortWithinPartitions("data_year", "codmunocor", "causabas")
    laid_out.write.mode("append").partitionBy("data_year").parquet(path)
