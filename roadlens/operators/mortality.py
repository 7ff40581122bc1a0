"""Reports over the table of traffic deaths.

Each report is one plan over one scan of the table, of which it reads the few columns that it names. What is
computed after the first aggregation works on a row for each year, city or mode.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from roadlens.functions.scalars import growth, mean2, percent
from roadlens.operators.predicates import equal, keep, starts_with, within
from roadlens.plans.dims import CYCLIST_PREFIX, MODES, PREFIXES, city_name
from roadlens.plans.params import YEARS, DeathFilter

def all_rows() -> WindowSpec:
    """All rows of an aggregated report: a handful, so that a window without key is no bottleneck."""
    return W.partitionBy(F.lit(1))


def _echo(value: object, kind: str) -> Column:
    return F.lit(value).cast(kind)


def summary(deaths: DataFrame, params: DeathFilter = DeathFilter()) -> DataFrame:
    """total_deaths, year, message."""
    message = f"Total traffic deaths in {params.year}" if params.year else "Total traffic deaths (all years)"
    counted = keep(deaths, equal("data_year", params.year)).agg(F.count("*").alias("total_deaths"))
    return counted.select("total_deaths", _echo(params.year, "int").alias("year"), F.lit(message).alias("message"))


def cyclist_message(year: int | None, city: int | None) -> str:
    if not year and not city:
        return "Cyclist deaths (all years and cities)"
    return "Cyclist deaths" + (f" in city {city}" if city else "") + (f" {'for' if city else 'in'} {year}" if year else "")


def cyclists(deaths: DataFrame, params: DeathFilter = DeathFilter()) -> DataFrame:
    """total_cyclist_deaths, percentage_of_total and the echoed filters; the city is the one of occurrence."""
    rows = keep(deaths, equal("data_year", params.year), equal("codmunocor", params.city_code))
    counted = rows.agg(F.count_if(F.col("causabas").startswith(CYCLIST_PREFIX)).alias("part"), F.count("*").alias("whole"))
    return counted.select(
        F.col("part").alias("total_cyclist_deaths"),
        _echo(params.year, "int").alias("year"),
        _echo(params.city_code, "int").alias("city_code"),
        percent(F.col("part"), F.col("whole")).alias("percentage_of_total"),
        F.lit(cyclist_message(params.year, params.city_code)).alias("message"),
    )


def by_city(deaths: DataFrame, params: DeathFilter = DeathFilter()) -> DataFrame:
    """rank, city_code, city_name, total_deaths, total: most deaths first, then by code; rows without a city
    count nowhere. Names are looked up after the aggregation."""
    city = params.city_column
    counted = keep(deaths, equal("data_year", params.year), F.col(city).isNotNull()).groupBy(F.col(city).alias("city_code")).agg(F.count("*").alias("total_deaths"))
    order = all_rows().orderBy(F.desc("total_deaths"), "city_code")
    return counted.select(
        F.row_number().over(order).alias("rank"), "city_code", city_name(F.col("city_code")).alias("city_name"), "total_deaths", F.sum("total_deaths").over(all_rows()).alias("total")
    )


def by_transport_mode(deaths: DataFrame, params: DeathFilter = DeathFilter()) -> DataFrame:
    """rank, mode, cid10_codes, total_deaths, percentage, total: the modes that occur, most deaths first and
    then in the order of the dimension. The total and the percentages are of the modes' sum."""
    rows = keep(deaths, equal("data_year", params.year), equal(params.city_column, params.city_code))
    counts = rows.agg(*[F.count_if(F.col("causabas").startswith(m.prefix)).alias(m.key) for m in MODES])
    listed = F.array(*[F.struct(F.lit(m.ordinal).alias("ordinal"), F.lit(m.label).alias("mode"), F.lit(m.codes).alias("cid10_codes"), F.col(m.key).alias("total_deaths")) for m in MODES])
    whole = sum((F.col(m.key) for m in MODES[1:]), F.col(MODES[0].key))
    flat = counts.select(F.explode(listed).alias("m"), whole.alias("total")).select("m.*", "total").filter("total_deaths > 0")
    return flat.select(
        F.row_number().over(all_rows().orderBy(F.desc("total_deaths"), "ordinal")).alias("rank"), "mode", "cid10_codes", "total_deaths", percent(F.col("total_deaths"), F.col("total")).alias("percentage"), "total"
    )


def zero_filled_years(counts: DataFrame, start: int, end: int) -> DataFrame:
    """year, total_deaths for every year of the span; none if it is reversed."""
    spine = counts.sparkSession.range(start, end + 1, 1, 1).select(F.col("id").cast("int").alias("year"))
    return spine.join(counts, F.col("year") == F.col("data_year"), "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("total_deaths"))


def time_series(deaths: DataFrame, params: DeathFilter = DeathFilter(), today: dt.date | None = None) -> DataFrame:
    """year, total_deaths, total, average_per_year for every year of the span, those without deaths too."""
    start = params.start_year or YEARS[0]
    end = params.end_year or (today or dt.date.today()).year
    mode = starts_with("causabas", [PREFIXES[params.transport_mode]]) if params.transport_mode else None
    rows = keep(deaths, within("data_year", start, end), equal(params.city_column, params.city_code), mode)
    years = zero_filled_years(rows.groupBy("data_year").agg(F.count("*").alias("n")), start, end)
    total = F.sum("total_deaths").over(all_rows())
    return years.select("year", "total_deaths", total.alias("total"), mean2(total, F.count("*").over(all_rows())).alias("average_per_year"))


def yearly_counts(deaths: DataFrame, params: DeathFilter = DeathFilter()) -> DataFrame:
    """data_year, total_deaths; a null year is a group of its own."""
    return keep(deaths, equal(params.city_column, params.city_code)).groupBy("data_year").agg(F.count("*").alias("total_deaths"))


def stats(deaths: DataFrame, params: DeathFilter = DeathFilter(), today: dt.date | None = None) -> DataFrame:
    """Latest and previous year with growth, the most violent year, the last five years and all time, in a row.

    The previous year is the one before the latest, whether it has deaths or not. Five-year means divide by
    five, all-time ones by the span of years. Of equal years the earliest is the most violent, a null year
    after all others; it then bears the latest year's number. Without rows the span is from 2015 to today.
    """
    this_year = (today or dt.date.today()).year
    years = yearly_counts(deaths, params).withColumn("last", F.max("data_year").over(all_rows())).withColumn("first", F.min("data_year").over(all_rows()))
    on = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("total_deaths"))), F.lit(0))
    year, last = F.col("data_year"), F.col("last")
    rank = F.struct("total_deaths", -F.coalesce(year, F.lit(9999)))
    folded = years.agg(
        F.coalesce(F.max("last"), F.lit(this_year)).alias("latest_year"),
        F.coalesce(F.min("first"), F.lit(YEARS[0])).alias("first_year"),
        on(year == last).alias("latest_year_deaths"),
        on(year == last - 1).alias("previous_year_deaths"),
        F.max_by(F.struct(F.coalesce(year, last).alias("year"), "total_deaths"), rank).alias("most"),
        on(year.between(last - 4, last)).alias("last_5_years_total"),
        F.coalesce(F.sum("total_deaths"), F.lit(0)).alias("all_time_total"),
    )
    covered = F.col("latest_year") - F.col("first_year") + 1
    return folded.select(
        "latest_year",
        "latest_year_deaths",
        "previous_year_deaths",
        growth(F.col("latest_year_deaths"), F.col("previous_year_deaths")).alias("growth_percentage"),
        F.coalesce("most.year", "latest_year").alias("most_violent_year"),
        F.coalesce("most.total_deaths", F.lit(0)).alias("most_violent_year_deaths"),
        "last_5_years_total",
        mean2(F.col("last_5_years_total"), F.lit(5)).alias("last_5_years_average"),
        "all_time_total",
        covered.cast("long").alias("years_covered"),
        mean2(F.col("all_time_total"), covered).alias("all_time_average"),
    )


# Nested forms, as a service would answer them: one row each.


def nested_list(flat: DataFrame, items: str, order: str, fields: list[str], **scalars: Column) -> DataFrame:
    """One row with ``items`` (structs of ``fields`` in the order of ``order``) and ``scalars``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), F.struct(*fields).alias("item"))))
    return flat.agg(F.transform(ordered, lambda x: x["item"]).alias(items), *[c.alias(n) for n, c in scalars.items()])


def by_city_report(deaths: DataFrame, params: DeathFilter = DeathFilter()) -> DataFrame:
    flat = by_city(deaths, params)
    return nested_list(
        flat, "cities", "rank", ["city_code", "city_name", "total_deaths"],
        location_type=F.lit(params.location_type), year=_echo(params.year, "int"), total=F.coalesce(F.max("total"), F.lit(0)),
    )


def by_transport_mode_report(deaths: DataFrame, params: DeathFilter = DeathFilter()) -> DataFrame:
    flat = by_transport_mode(deaths, params)
    return nested_list(
        flat, "transport_modes", "rank", ["mode", "cid10_codes", "total_deaths", "percentage"],
        year=_echo(params.year, "int"), city_code=_echo(params.city_code, "int"), location_type=F.lit(params.location_type), total=F.coalesce(F.max("total"), F.lit(0)),
    )


def time_series_report(deaths: DataFrame, params: DeathFilter = DeathFilter(), today: dt.date | None = None) -> DataFrame:
    flat = time_series(deaths, params, today)
    return nested_list(
        flat, "data", "year", ["year", "total_deaths"],
        start_year=_echo(params.start_year or YEARS[0], "int"), end_year=_echo(params.end_year or (today or dt.date.today()).year, "int"),
        city_code=_echo(params.city_code, "int"), transport_mode=_echo(params.transport_mode, "string"), location_type=F.lit(params.location_type),
        total=F.coalesce(F.max("total"), F.lit(0)), average_per_year=F.coalesce(F.max("average_per_year"), F.lit(0.0)),
    )


def stats_report(deaths: DataFrame, params: DeathFilter = DeathFilter(), today: dt.date | None = None) -> DataFrame:
    return stats(deaths, params, today).select(
        _echo(params.city_code, "int").alias("city_code"),
        F.lit(params.location_type).alias("location_type"),
        "latest_year", "latest_year_deaths", "previous_year_deaths", "growth_percentage",
        F.struct(F.col("most_violent_year").alias("year"), F.col("most_violent_year_deaths").alias("total_deaths")).alias("most_violent_year"),
        F.struct(F.col("last_5_years_total").alias("total_deaths"), F.col("last_5_years_average").alias("average_per_year")).alias("last_5_years"),
        F.struct(F.col("all_time_total").alias("total_deaths"), "years_covered", F.col("all_time_average").alias("average_per_year")).alias("all_time"),
    )


def as_json(report: DataFrame) -> DataFrame:
    """One column ``json`` with the row as a document, null fields included."""
    return report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("json"))


# Checks after loading, and the aggregate that answers the reports without the table.


def load_check(deaths: DataFrame) -> DataFrame:
    """data_year, total, cyclists by year, and under a null year of the whole table: one scan, one shuffle."""
    counts = [F.count("*").alias("total"), F.count_if(F.col("causabas").startswith(CYCLIST_PREFIX)).alias("cyclists")]
    return deaths.rollup("data_year").agg(*counts, F.grouping_id().alias("level"))


def cube(deaths: DataFrame) -> DataFrame:
    """data_year, codmunocor, codmunres, mode, n: deaths by all that the reports filter on. Written once, it
    answers them from a few thousand rows; ``mode`` is null for codes that belong to none."""
    mode = F.coalesce(*[F.when(F.col("causabas").startswith(m.prefix), F.lit(m.key)) for m in MODES])
    return deaths.groupBy("data_year", "codmunocor", "codmunres", mode.alias("mode")).agg(F.count("*").alias("n"))
