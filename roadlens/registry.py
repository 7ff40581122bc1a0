"""The registered queries of the mobility operators, each with the SQL that gives the same rows.

A query reads whole tables; a filter in one is what the operator takes as its parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens import ingest_queries  # noqa: F401 (registers its queries)
from roadlens.catalogue import QUERIES, SQL, Query, register
from roadlens.functions import scalars as S
from roadlens.operators import constraints, counting, mortality, predicates, profiles
from roadlens.plans.dims import CITIES, MODES, PREFIXES, city_name
from roadlens.plans.params import YEARS, DeathFilter, EventFilter, InvalidParameter, row_id
from roadlens.sources import counts as count_load
from roadlens.sources import deaths as death_load
from roadlens.sources import loading

SPAN = DeathFilter(start_year=2015, end_year=2023)


def pct(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then ((20000 * cast({part} as bigint) + {whole}) // (2 * {whole})) / 100.0::double else 0.0::double end"


def mean(total: str, n: str) -> str:
    return f"((200 * cast({total} as bigint) + {n}) // (2 * {n})) / 100.0::double"


def shifted(f: Callable[..., DataFrame]) -> Query:
    """The test tables' years are twenty years early: the report's parameters hold years from 2015 on."""

    return lambda spark, sf_dir: f(A.deaths(spark, sf_dir).withColumn("data_year", F.col("data_year") + 20))


#: The same in SQL.
TD20 = "td20 as (select causabas, data_year + 20 as data_year, codmunocor, codmunres from td)"
MODE_SQL = "modes as (select * from (values " + ", ".join(f"({m.ordinal}, '{m.key}', '{m.label}', '{m.codes}', '{m.prefix}')" for m in MODES) + ") as t(ordinal, key, mode, cid10_codes, prefix))"
CITY_SQL = "cities as (select * from (values " + ", ".join(f"({c}, '{n}')" for c, n in CITIES.items()) + ") as t(city_code, city_name))"


def td20(select: str, *more: str) -> str:
    return "with " + ", ".join([f"td as ({A.SQL['td']})", TD20, *more]) + " " + select


def _report(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = shifted(f)
    SQL[name] = sql


# Totals


_report("summary_all", td20("select count(*) as total_deaths, cast(null as int) as year, 'Total traffic deaths (all years)' as message from td20"), mortality.summary)
_report(
    "summary_year",
    td20("select count(*) as total_deaths, cast(2017 as int) as year, 'Total traffic deaths in 2017' as message from td20 where data_year = 2017"),
    lambda d: mortality.summary(d, DeathFilter(year=2017)),
)


def _cyclists_sql(year: int | None, city: int | None) -> str:
    where = " and ".join(["true", *([f"data_year = {year}"] if year else []), *([f"codmunocor = {city}"] if city else [])])
    c = f"c as (select count(*) as n, coalesce(sum(case when causabas like 'V1%' then 1 else 0 end), 0) as k from td20 where {where})"
    message = mortality.cyclist_message(year, city)
    echo = lambda v: f"cast({'null' if v is None else v} as int)"
    return td20(f"select cast(k as bigint) as total_cyclist_deaths, {echo(year)} as year, {echo(city)} as city_code, {pct('k', 'n')} as percentage_of_total, '{message}' as message from c", c)


for _name, _year, _city in (("all", None, None), ("year", 2018, None), ("city", None, 2607901), ("city_year", 2018, 2607901), ("nowhere", None, 99)):
    _report(f"cyclists_{_name}", _cyclists_sql(_year, _city), lambda d, y=_year, c=_city: mortality.cyclists(d, DeathFilter(year=y, city_code=c)))


# By city and by mode


def _by_city_sql(column: str, year: int | None) -> str:
    where = f"{column} is not null" + (f" and data_year = {year}" if year else "")
    g = f"g as (select {column} as city_code, count(*) as total_deaths from td20 where {where} group by {column})"
    return td20(
        "select cast(row_number() over (order by total_deaths desc, g.city_code) as int) as rank, g.city_code, city_name, total_deaths, cast(sum(total_deaths) over () as bigint) as total "
        "from g left join cities on g.city_code = cities.city_code", g, CITY_SQL,
    )


_report("by_city_occurrence", _by_city_sql("codmunocor", None), mortality.by_city)
_report("by_city_residence_year", _by_city_sql("codmunres", 2019), lambda d: mortality.by_city(d, DeathFilter(year=2019, location_type="residence")))


def _by_mode_sql(where: str) -> str:
    counts = f"c as (select ordinal, mode, cid10_codes, count(*) as n from td20 join modes on causabas like prefix || '%' where {where} group by 1, 2, 3), s as (select sum(n)::bigint as t from c)"
    return td20(f"select cast(row_number() over (order by n desc, ordinal) as int) as rank, mode, cid10_codes, n as total_deaths, {pct('n', 't')} as percentage, t as total from c, s", MODE_SQL, counts)


_report("by_transport_mode", _by_mode_sql("true"), mortality.by_transport_mode)
_report("by_transport_mode_year", _by_mode_sql("data_year = 2019"), lambda d: mortality.by_transport_mode(d, DeathFilter(year=2019)))
_report("by_transport_mode_city", _by_mode_sql("codmunocor = 2607901"), lambda d: mortality.by_transport_mode(d, DeathFilter(city_code=2607901)))
_report("by_transport_mode_residence", _by_mode_sql("codmunres = 2600054"), lambda d: mortality.by_transport_mode(d, DeathFilter(city_code=2600054, location_type="residence")))


# Series and statistics


def _series_sql(start: int, end: int, where: str = "true") -> str:
    parts = (
        f"y as (select cast(unnest(range({start}, {end + 1})) as int) as year)",
        f"g as (select data_year, count(*) as n from td20 where data_year between {start} and {end} and {where} group by data_year)",
        "f as (select year, cast(coalesce(n, 0) as bigint) as total_deaths from y left join g on year = data_year)",
        "s as (select cast(sum(total_deaths) as bigint) as t, count(*) as k from f)",
    )
    return td20(f"select year, total_deaths, t as total, {mean('t', 'k')} as average_per_year from f, s", *parts)


_report("time_series_all", _series_sql(2015, 2023), lambda d: mortality.time_series(d, SPAN))
_report("time_series_mode_zero_fill", _series_sql(2019, 2029, "causabas like 'V1%'"), lambda d: mortality.time_series(d, DeathFilter(start_year=2019, end_year=2029, transport_mode="cyclist")))
_report(
    "time_series_city_residence",
    _series_sql(2016, 2020, "codmunres = 2609600"),
    lambda d: mortality.time_series(d, DeathFilter(start_year=2016, end_year=2020, city_code=2609600, location_type="residence")),
)
_report("yearly_counts", td20("select data_year, count(*) as total_deaths from td20 group by data_year"), mortality.yearly_counts)


def _stats_sql(where: str) -> str:
    parts = (
        f"y as (select data_year as yr, count(*) as n from td20 where {where} group by data_year)",
        "b as (select max(yr) as l, min(yr) as f, cast(sum(n) as bigint) as t from y)",
        "m as (select yr, n from y order by n desc, yr limit 1)",
        "v as (select l, f, t, cast(coalesce(sum(case when yr = l then n end), 0) as bigint) as cur, cast(coalesce(sum(case when yr = l - 1 then n end), 0) as bigint) as prev, "
        "cast(coalesce(sum(case when yr between l - 4 and l then n end), 0) as bigint) as five from y, b group by l, f, t)",
    )
    return td20(
        f"""select cast(l as int) as latest_year, cur as latest_year_deaths, prev as previous_year_deaths,
        sign(cur - prev)::double * {pct("abs(cur - prev)", "prev")} as growth_percentage,
        cast(m.yr as int) as most_violent_year, m.n as most_violent_year_deaths, five as last_5_years_total, {mean("five", "5")} as last_5_years_average,
        t as all_time_total, cast(l - f + 1 as bigint) as years_covered, {mean("t", "(l - f + 1)")} as all_time_average from v, m""", *parts,
    )


_report("stats_all", _stats_sql("true"), mortality.stats)
_report("stats_city", _stats_sql("codmunocor = 2607901"), lambda d: mortality.stats(d, DeathFilter(city_code=2607901)))
_report("stats_residence", _stats_sql("codmunres = 2607901"), lambda d: mortality.stats(d, DeathFilter(city_code=2607901, location_type="residence")))
_report("growth_rate", "select latest_year, growth_percentage from (" + _stats_sql("true") + ")", lambda d: mortality.stats(d).select("latest_year", "growth_percentage"))
_report("argmax_year", "select most_violent_year, most_violent_year_deaths from (" + _stats_sql("true") + ")", lambda d: mortality.stats(d).select("most_violent_year", "most_violent_year_deaths"))
_report("trailing_five_years", "select last_5_years_total, last_5_years_average from (" + _stats_sql("true") + ")", lambda d: mortality.stats(d).select("last_5_years_total", "last_5_years_average"))


# Nested reports: documents as a service answers them. SQL packs the flat forms, whose SQL is above.

_DOCUMENTS = {
    "by_city_document": (
        mortality.by_city_report,
        "select to_json({cities: list({city_code: city_code, city_name: city_name, total_deaths: total_deaths} order by rank), location_type: 'occurrence', "
        "year: cast(null as int), total: coalesce(max(total), 0)})::varchar as json from flat",
        _by_city_sql("codmunocor", None),
    ),
    "by_transport_mode_document": (
        mortality.by_transport_mode_report,
        "select to_json({transport_modes: list({mode: mode, cid10_codes: cid10_codes, total_deaths: total_deaths, percentage: percentage} order by rank), year: cast(null as int), "
        "city_code: cast(null as int), location_type: 'occurrence', total: coalesce(max(total), 0)})::varchar as json from flat",
        _by_mode_sql("true"),
    ),
    "time_series_document": (
        lambda d: mortality.time_series_report(d, SPAN),
        "select to_json({data: list({year: year, total_deaths: total_deaths} order by year), start_year: 2015, end_year: 2023, city_code: cast(null as int), transport_mode: cast(null as varchar), "
        "location_type: 'occurrence', total: coalesce(max(total), 0), average_per_year: coalesce(max(average_per_year), 0.0::double)})::varchar as json from flat",
        _series_sql(2015, 2023),
    ),
    "stats_document": (
        mortality.stats_report,
        "select to_json({city_code: cast(null as int), location_type: 'occurrence', latest_year: latest_year, latest_year_deaths: latest_year_deaths, previous_year_deaths: previous_year_deaths, "
        "growth_percentage: growth_percentage, most_violent_year: {year: most_violent_year, total_deaths: most_violent_year_deaths}, "
        "last_5_years: {total_deaths: last_5_years_total, average_per_year: last_5_years_average}, "
        "all_time: {total_deaths: all_time_total, years_covered: years_covered, average_per_year: all_time_average}})::varchar as json from flat",
        _stats_sql("true"),
    ),
}
for _name, (_f, _select, _flat) in _DOCUMENTS.items():
    QUERIES[_name] = shifted(lambda d, f=_f: mortality.as_json(f(d)))
    SQL[_name] = f"with flat as ({_flat}) {_select}"


_report(
    "load_check",
    td20("select data_year, count(*) as total, cast(sum(case when causabas like 'V1%' then 1 else 0 end) as bigint) as cyclists, cast(0 as bigint) as level from td20 group by data_year "
         "union all select null, count(*), cast(sum(case when causabas like 'V1%' then 1 else 0 end) as bigint), cast(1 as bigint) from td20"),
    mortality.load_check,
)
_report(
    "cube",
    td20("select data_year, codmunocor, codmunres, key as mode, count(*) as n from td20 left join modes on causabas like prefix || '%' group by 1, 2, 3, 4", MODE_SQL),
    mortality.cube,
)


# Primitives over the deaths


@register("select causabas, data_year, codmunocor from td where codmunocor = 2607901", "td")
def filter_eq_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.keep(A.deaths(spark, sf_dir), predicates.equal("codmunocor", 2607901)).select("causabas", "data_year", "codmunocor")


@register("select causabas, data_year, idade from td where data_year between 1996 and 1998 and causabas like 'V1%'", "td")
def filter_like_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicates.keep(A.deaths(spark, sf_dir), predicates.within("data_year", 1996, 1998), predicates.starts_with("causabas", ["V1"]))
    return rows.select("causabas", "data_year", "idade")


@register("select causabas, idade from td where idade between 10 and 12", "td")
def filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.where(A.deaths(spark, sf_dir), [("idade", "between", (10, 12))]).select("causabas", "idade")


@register("select codmunocor, codmunres from td where codmunocor in (2607901, 2609600) and codmunres not in (2607901)", "td")
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.where(A.deaths(spark, sf_dir), [("codmunocor", "in", [2607901, 2609600]), ("codmunres", "not_in", [2607901])]).select("codmunocor", "codmunres")


@register("select cast(sum(case when codmunocor is null then 1 else 0 end) as bigint) as without_city, cast(sum(case when codmunres is not null then 1 else 0 end) as bigint) as with_home from td", "td")
def filter_null_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.deaths(spark, sf_dir).agg(F.count_if(F.col("codmunocor").isNull()).alias("without_city"), F.count_if(F.col("codmunres").isNotNull()).alias("with_home"))


@register("select causabas, sexo from td where (causabas like 'V2%' or causabas like 'V99%') and sexo not like 'A%' and lower(sexo) like 'n' and idade <> 10 and idade > 5 and idade < 40 and idade not between 20 and 30", "td")
def predicate_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicates.keep(A.deaths(spark, sf_dir), predicates.starts_with("causabas", [PREFIXES["motorcyclist"], PREFIXES["unspecified"]]))
    tests = [("sexo", "not_like", "A%"), ("sexo", "ilike", "n"), ("idade", "ne", 10), ("idade", "gt", 5), ("idade", "lt", 40), ("idade", "not_between", (20, 30))]
    return predicates.where(rows, tests).select("causabas", "sexo")


for _kind, _column in (("occurrence", "codmunocor"), ("residence", "codmunres")):
    QUERIES[f"dynamic_location_{_kind}"] = lambda spark, sf_dir, c=DeathFilter(location_type=_kind).city_column: A.deaths(spark, sf_dir).groupBy(F.col(c).alias("city_code")).agg(F.count("*").alias("n"))
    SQL[f"dynamic_location_{_kind}"] = A.with_tables(f"select {_column} as city_code, count(*) as n from td group by {_column}", "td")


@register("select causabas, n, " + pct("n", "t") + " as share from (select causabas, count(*) as n, cast(sum(count(*)) over () as bigint) as t from td group by causabas)", "td")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = A.deaths(spark, sf_dir).groupBy("causabas").agg(F.count("*").alias("n"))
    return counted.select("causabas", "n", S.percent(F.col("n"), F.sum("n").over(mortality.all_rows())).alias("share"))


@register("select codmunocor as city_code, city_name, count(*) as n from td left join cities on codmunocor = city_code group by 1, 2")
def label_lookup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = A.deaths(spark, sf_dir).groupBy(F.col("codmunocor").alias("city_code")).agg(F.count("*").alias("n"))
    return counted.select("city_code", city_name(F.col("city_code")).alias("city_name"), "n")


SQL["label_lookup_map"] = f"with td as ({A.SQL['td']}), {CITY_SQL} " + SQL["label_lookup_map"]


@register("select distinct data_year from td where data_year not in (1995, 1996, 1999)", "td")
def anti_join_new_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.deaths(spark, sf_dir)
    loaded = spark.createDataFrame([(1995,), (1996,), (1999,)], "data_year int")
    return death_load.new_years(rows, loaded).select("data_year").distinct()


# The counts family


@register("select * from loc", "loc")
def scan_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.locations(A.locations(spark, sf_dir))


@register("select * from loc where city = 'NATION_3'", "loc")
def locations_in_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.locations(A.locations(spark, sf_dir), "NATION_3")


@register("select * from loc where id = 7", "loc")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.get(A.locations(spark, sf_dir), 7)


@register("select * from evt where counting_date >= date '1996-03-01' and counting_date <= date '1996-05-31'", "evt")
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.events(A.events(spark, sf_dir), A.locations(spark, sf_dir), EventFilter(start_date="1996-03-01", end_date="1996-05-31"))


@register("select * from evt where location_id = 3", "evt")
def events_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.events(A.events(spark, sf_dir), A.locations(spark, sf_dir), EventFilter(location_id=3))


@register("select evt.* from evt join loc on evt.location_id = loc.id where loc.city = (select min(city) from loc where id < 10) and counting_date >= date '1997-01-01'", "evt", "loc")
def events_by_city_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = A.locations(spark, sf_dir)
    city = places.filter("id < 10").agg(F.min("city")).first()[0]
    return counting.events(A.events(spark, sf_dir), places, EventFilter(city=city, start_date="1997-01-01"))


@register("select * from evt where location_id = 4", "evt")
def events_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.events_of_location(A.locations(spark, sf_dir), A.events(spark, sf_dir), 4)


@register("select event_id, session_label, total_cyclists from ses where event_id = 42", "ses")
def sessions_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.children(A.all_events(spark, sf_dir), A.sessions(spark, sf_dir), "event_id", 42, "session_label")


@register("select * from alle where exists (select 1 from ses where ses.event_id = alle.id and total_cyclists >= 45)", "alle", "ses")
def semi_join_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = A.sessions(spark, sf_dir).filter("total_cyclists >= 45")
    return predicates.exists(A.all_events(spark, sf_dir), busy, "id", "event_id")


@register("select * from alle where not exists (select 1 from ses where ses.event_id = alle.id)", "alle", "ses")
def events_without_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.missing(A.all_events(spark, sf_dir), A.sessions(spark, sf_dir), "id", "event_id")


@register("select alle.*, count(event_id) as n_children from alle left join ses on event_id = id group by id, location_id, counting_date", "alle", "ses")
def children_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.with_children(A.all_events(spark, sf_dir), A.sessions(spark, sf_dir), "event_id")


@register("select loc.id, loc.city, prof.event_type, prof.user_id from loc left join prof on loc.id = prof.user_id", "loc", "prof")
def left_join_cross_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, riders = A.locations(spark, sf_dir), A.profiles(spark, sf_dir).select("event_type", "user_id")
    return profiles.joined_left(places, riders, "id", "user_id").select("id", "city", "event_type", "user_id")


@register("select loc.id, name, cast(sum(total_cyclists) as bigint) as total_cyclists from loc join evt on loc.id = location_id group by loc.id, name", "loc", "evt")
def totals_per_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.totals_per_location(A.locations(spark, sf_dir), A.events(spark, sf_dir))


@register("select session_label, avg(total_cyclists) as avg_cyclists from ses group by session_label", "ses")
def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.peak_hours(A.sessions(spark, sf_dir)).drop("max_cyclists")


@register("select session_label, avg(total_cyclists) as avg_cyclists, max(total_cyclists) as max_cyclists from ses group by session_label", "ses")
def peak_hours_avg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.peak_hours(A.sessions(spark, sf_dir))


@register("select evt.* from evt join loc on location_id = loc.id where loc.city = (select max(city) from loc where id < 10) and extract(year from counting_date) = 1998", "evt", "loc")
def events_in_city_and_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = A.locations(spark, sf_dir)
    city = places.filter("id < 10").agg(F.max("city")).first()[0]
    return counting.events_in_city_and_year(A.events(spark, sf_dir), places, city, 1998)


@register("select from_direction, to_direction, cast(sum(cnt) as bigint) as total from mov group by 1, 2", "mov")
def movement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.movement_matrix(A.movements(spark, sf_dir))


@register("select from_direction, to_direction, cast(sum(cnt) as bigint) as total from mov join alle on event_id = id where location_id = 5 group by 1, 2", "mov", "alle")
def movement_matrix_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Here movements hang on events: each event is its own session.
    events = A.all_events(spark, sf_dir)
    sessions = events.select("id", F.col("id").alias("event_id"))
    return counting.movement_matrix(A.movements(spark, sf_dir).withColumnRenamed("event_id", "session_id"), sessions, events, 5)


@register("select to_direction, cast(sum(cnt) as bigint) as total from mov group by 1 order by total desc, to_direction limit 1", "mov")
def top_incoming_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.busiest_entry(A.movements(spark, sf_dir))


@register("select from_direction, to_direction, cast(sum(cnt) as bigint) as total from mov group by 1, 2 order by total desc, from_direction, to_direction limit 1", "mov")
def commonest_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.commonest_movement(A.movements(spark, sf_dir))


@register("select cast(sum(cnt) as bigint) as total from mov where from_direction = 'north' and to_direction = 'south'", "mov")
def north_south_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.volume(A.movements(spark, sf_dir), "north", "south")


@register("select event_id, from_direction, to_direction, cnt from mov where event_id = 42", "mov")
def movements_of_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counting.children(A.all_events(spark, sf_dir), A.movements(spark, sf_dir), "event_id", 42, "from_direction")
    return rows.withColumnRenamed("count", "cnt")


_AWAY = "2 * 6371008.8 * asin(sqrt(power(sin(radians(latitude::double - 5.0) / 2), 2) + cos(radians(5.0)) * cos(radians(latitude::double)) * power(sin(radians(longitude::double + 34.9) / 2), 2)))"


@register(f"select id, name, latitude, longitude from loc where {_AWAY} <= 200000", "loc")
def geo_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.within_radius(A.locations(spark, sf_dir), 5.0, -34.9, 200_000).select("id", "name", "latitude", "longitude")


@register("select * from alle where id = 42", "alle")
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.get(A.all_events(spark, sf_dir), 42)


@register("select * from kses where id = (select min(id) from kses where event_id >= 42)", "kses")
def session_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = A.keyed_sessions(spark, sf_dir)
    return counting.get(sessions, sessions.filter("event_id >= 42").agg(F.min("id")).first()[0])


@register("select kmov.id, session_id, from_direction, to_direction, kmov.count from kmov where session_id = (select min(id) from kses where event_id >= 42)", "kmov", "kses")
def movements_of_a_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = A.keyed_sessions(spark, sf_dir)
    return counting.movements_of_session(sessions, A.keyed_movements(spark, sf_dir), sessions.filter("event_id >= 42").agg(F.min("id")).first()[0])


@register(
    "select from_direction, to_direction, cast(sum(kmov.count) as bigint) as total from kmov join kses on session_id = kses.id join alle on event_id = alle.id where location_id = 5 group by 1, 2",
    "kmov", "kses", "alle",
)
def movement_matrix_by_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of movement, session and event, each with ids of its own."""
    return counting.movement_matrix(A.keyed_movements(spark, sf_dir), A.keyed_sessions(spark, sf_dir), A.all_events(spark, sf_dir), 5)


@register("select id, city, is_rmr from rmr where is_rmr = 'true'", "rmr")
def metropolitan_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = A.locations(spark, sf_dir)
    described = places.withColumn("metadata", F.to_json(F.struct((F.col("id") % 3 == 0).alias("is_rmr"), F.lit("x").alias("state_full"))))
    return counting.metropolitan(described).select("id", "city", S.json_text(F.col("metadata"), "is_rmr").alias("is_rmr"))


@register("select loc.id, loc.city, prof.event_type, prof.user_id from loc left join prof on loc.id = prof.user_id where loc.city = (select min(city) from loc where id < 10)", "loc", "prof")
def left_join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join across services with a filter on its left side."""
    places = A.locations(spark, sf_dir)
    city = places.filter("id < 10").agg(F.min("city")).first()[0]
    joined = profiles.joined_left(places, A.profiles(spark, sf_dir).select("event_type", "user_id"), "id", "user_id")
    return predicates.keep(joined, predicates.equal("city", city)).select("id", "city", "event_type", "user_id")


_NESTED_MOVES = "m as (select session_id, list({id: id, session_id: session_id, from_direction: from_direction, to_direction: to_direction, count: count} order by id) as movements from kmov group by session_id)"
_NESTED_SESSIONS = (
    "s as (select event_id, list({id: id, event_id: event_id, session_label: session_label, total_cyclists: total_cyclists, movements: movements} order by id) as sessions "
    "from kses join m on id = session_id group by event_id)"
)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.nested_events(A.all_events(spark, sf_dir), A.keyed_sessions(spark, sf_dir), A.keyed_movements(spark, sf_dir))


@register("select alle.id, count(kses.id) as n_sessions, cast(coalesce(sum(total_cyclists), 0) as bigint) as total from alle left join kses on event_id = alle.id group by alle.id", "alle", "kses")
def nested_event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested documents, folded back to totals."""
    total = F.aggregate("sessions", F.lit(0).cast("long"), lambda a, s: a + s["total_cyclists"])
    return _nested(spark, sf_dir).select("id", F.size("sessions").cast("long").alias("n_sessions"), total.alias("total"))


@register()
def nested_event_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _nested(spark, sf_dir)
    return nested.select("id", F.to_json(F.struct(*nested.columns), {"ignoreNullFields": "false"}).alias("json"))


SQL["nested_event_document"] = (
    A.with_tables("", "alle", "kses", "kmov").strip()
    + f", {_NESTED_MOVES}, {_NESTED_SESSIONS} select alle.id, to_json({{id: alle.id, location_id: location_id, counting_date: counting_date, sessions: coalesce(sessions, [])}})::varchar as json "
    "from alle left join s on event_id = alle.id"
)


# Documents and profiles


@register("select * from prof", "prof")
def scan_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profiles(A.profiles(spark, sf_dir))


@register("select * from prof where id = 11", "prof")
def profile_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile(A.profiles(spark, sf_dir), 11)


@register("select id, cast(json_extract_string(data, '$.k') as int) as k from prof", "prof")
def json_extract_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.profiles(spark, sf_dir).select("id", S.json_int(F.col("data"), "k").alias("k"))


@register("select id, data from prof where cast(json_extract_string(data, '$.k') as int) > 20", "prof")
def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.sessions_above(A.profiles(spark, sf_dir).withColumn("characteristics", F.col("data")), "k", 20).select("id", "data")


@register("select id, metadata from prof where json_extract_string(metadata, '$.k') = '5'", "prof")
def json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.containing(A.profiles(spark, sf_dir), "metadata", k=5).select("id", "metadata")


@register("select id, data from prof where json_extract_string(data, '$.k') = '7'", "prof")
def json_text_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.profiles(spark, sf_dir).filter(S.json_text(F.col("data"), "k") == "7").select("id", "data")


# Ingest steps


@register("select l_orderkey, cast(l_shipdate as date) as day from lineitem")
def date_parse_ddmmyyyy(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = A.table(spark, sf_dir, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "ddMMyyyy").alias("text"))
    return written.select("l_orderkey", S.compact_date(F.col("text")).alias("day"))


@register("select event_id, cast(user_id as int) as number from events")
def int_prefix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", S.leading_int(F.concat(F.lit(" "), F.col("user_id").cast("string"), "event_type")).alias("number"))


@register("select event_id, 'sha256:' || sha256(props) as mark from events")
def sha256_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", S.sha256_mark(F.col("props").cast("binary")).alias("mark"))


@register("select a.city, a.id, a.name from loc a join (select city, min(id) as m from loc group by city) b on a.city = b.city and a.id = b.m", "loc")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_load.first_wins(A.locations(spark, sf_dir).select("city", "id", "name"), ["city"], ["id"])


@register("select event_id, cast(sum(total_cyclists) as int) as total_cyclists, max(total_cyclists) as max_hour_cyclists from ses group by event_id", "ses")
def array_fold_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = A.sessions(spark, sf_dir).groupBy("event_id").agg(F.collect_list(F.struct("total_cyclists", F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("end_time"))).alias("sessions"))
    totals = count_load.session_totals(F.col("sessions"))
    return folded.select("event_id", *[totals[n].alias(n) for n in ("total_cyclists", "max_hour_cyclists")])


@register("select event_id, from_direction, to_direction, cast(sum(cnt) as int) as cnt from mov group by 1, 2, 3", "mov")
def unpivot_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve columns an event, made by a pivot, turned back into a row for each movement that happened."""
    from roadlens.plans.schemas import MOVEMENT_KEYS

    rows = A.movements(spark, sf_dir)
    pair = F.concat_ws("_", "from_direction", "to_direction")
    wide = rows.groupBy("event_id").agg(F.struct(*[F.coalesce(F.sum(F.when(pair == k, F.col("count"))), F.lit(0)).cast("int").alias(k) for k in MOVEMENT_KEYS]).alias("quantitative"))
    return count_load.unpivot_movements(wide, key="event_id").select("event_id", "from_direction", "to_direction", F.col("count").alias("cnt"))


_RULES = {"idade from 0 to 150": "idade between 0 and 150", "sexo in 0/1/2": "sexo in ('0', '1', '2')", "sexo up to 1": "length(sexo) <= 1"}


@register(" union all ".join(f"select '{n}' as rule, cast(coalesce(sum(case when not ({c}) then 1 else 0 end), 0) as bigint) as n from td" for n, c in _RULES.items()), "td")
def validate_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.deaths(spark, sf_dir)
    rules = constraints.death_rules(rows.columns)
    return constraints.violations(rows, {n: rules[n] for n in _RULES})


_FAULTY = {
    "from a direction": "from_direction in ('north', 'east', 'south', 'west')",
    "to a direction": "to_direction in ('north', 'east', 'south', 'west')",
    "from is not to": "from_direction <> to_direction",
    "count not negative": "cnt >= 0",
}


@register(" union all ".join(f"select '{n}' as rule, cast(coalesce(sum(case when not ({c}) then 1 else 0 end), 0) as bigint) as n from faulty" for n, c in _FAULTY.items()), "faulty")
def validate_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements made faulty: from and to the same, unknown directions, negative counts."""
    rules = constraints.movement_rules()
    return constraints.violations(A.faulty_movements(spark, sf_dir), {n: rules[n] for n in _FAULTY})


@register("select id, location_id from evt where location_id not in (select id from loc where id not in (3, 4))", "evt", "loc")
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose place is not among those that are left when two are taken away."""
    left = A.locations(spark, sf_dir).filter("id not in (3, 4)")
    return constraints.orphans(A.events(spark, sf_dir), "location_id", left).select("id", "location_id")


@register("select from_direction, cnt, count(*) as n from mov group by 1, 2 having count(*) > 1", "mov")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.repeated_keys(A.movements(spark, sf_dir).withColumnRenamed("count", "cnt"), "from_direction", "cnt")


@register("select evt.id, evt.total_cyclists + id % 2 as total_cyclists from evt where id % 2 = 1", "evt")
def uneven_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose total was changed, told by the sums of their sessions."""
    changed = A.events(spark, sf_dir).withColumn("total_cyclists", F.col("total_cyclists") + F.col("id") % 2)
    return constraints.uneven_totals(changed, A.sessions(spark, sf_dir)).select("id", "total_cyclists")


_FAR = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(latitude::double + 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(latitude::double)) * power(sin(radians(longitude - 175.0) / 2), 2))))"


@register(f"select id, latitude, longitude from (select id, latitude, cast((id * 37) % 360 - 180 as double) as longitude from loc) where {_FAR} <= 4000000", "loc")
def geo_radius_over_the_date_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places all around the earth, within a circle that the date line cuts."""
    places = A.locations(spark, sf_dir).withColumn("longitude", ((F.col("id") * 37) % 360 - 180).cast("double"))
    return counting.within_radius(places, -10.0, 175.0, 4_000_000).select("id", "latitude", "longitude")


@register(f"select id, latitude, longitude from (select id, latitude, cast((id * 37) % 360 - 180 as double) as longitude from loc) where {_FAR.replace('175.0', '20.0')} <= 3000000", "loc")
def geo_radius_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a box of degrees narrows both coordinates first."""
    places = A.locations(spark, sf_dir).withColumn("longitude", ((F.col("id") * 37) % 360 - 180).cast("double"))
    return counting.within_radius(places, -10.0, 20.0, 3_000_000).select("id", "latitude", "longitude")


# Names, texts and parameters


@register("select n_name as name, 'nation-' || n_nationkey as kebab, 'nation_' || n_nationkey as snake, 'nation' || n_nationkey as camel, 'Nation' || n_nationkey as pascal from nation")
def name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return A.table(spark, sf_dir, "nation").select(name.alias("name"), *[S.text_case(name, style).alias(style) for style in ("kebab", "snake", "camel", "pascal")])


@register("select n_name as name, n_nationkey % 2 = 0 as valid from nation")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in kebab case are valid, and those that end with a hyphen or hold a capital are not."""
    name, kebab = F.col("n_name"), S.text_case(F.col("n_name"), "kebab")
    made = F.when(F.col("n_nationkey") % 2 == 0, kebab).when(F.col("n_nationkey") % 4 == 1, F.concat(kebab, F.lit("-"))).otherwise(name)
    return A.table(spark, sf_dir, "nation").select(name.alias("name"), S.valid_name(made).alias("valid"))


@register("select 'service ' || lower(n_name) || ' on port ' || (3000 + n_nationkey) || ' (' || n_name || ')' as line from nation")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = S.fill_template(F.lit("service {{low}} on port {{port}} ({{name}})"), low=F.lower("n_name"), port=F.col("n_nationkey") + 3000, name=F.col("n_name"))
    return A.table(spark, sf_dir, "nation").select(text.alias("line"))


@register("select case when n_nationkey % 3 = 0 then 'failed' else 'ok' end || ' | ' || rpad(n_name, 20, ' ') || ' | ' || n_nationkey || '.00s' || case when n_nationkey % 3 = 0 then ' | no data' else '' end as line from nation")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a load's report: a mark, the padded name, the seconds, and the error of what failed."""
    bad = F.col("n_nationkey") % 3 == 0
    rows = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("task"), (~bad).alias("success"), F.col("n_nationkey").cast("double").alias("seconds"), F.when(bad, F.lit("no data")).alias("error"))
    return loading.lines(rows)


def _accepted(make: Callable[[], object]) -> bool:
    try:
        make()
    except InvalidParameter:
        return False
    return True


@register(f"""select k, (2005 + k) between {YEARS[0]} and {YEARS[-1]} as year, k > 3 as location, k % 2 = 0 as day, k % 3 <> 2 as place_type, k % 5 <> 4 as mode, k % 4 = 0 as whole
  from (select cast(n_nationkey as int) as k from nation)""")  # fmt: skip
def parameter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parameters are accepted: a few for each of the nations, which are as many at any scale."""
    keys = [r["n_nationkey"] for r in A.table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    modes = ["cyclist", "bus", "other", "unspecified", "boat"]
    rows = [
        (
            k, _accepted(lambda k=k: DeathFilter(year=2005 + k)), _accepted(lambda k=k: EventFilter(location_id=k - 3)), _accepted(lambda k=k: EventFilter(start_date=f"2020-{'02' if k % 2 == 0 else '13'}-01")),
            _accepted(lambda k=k: DeathFilter(location_type=("occurrence", "residence", "birth")[k % 3])), _accepted(lambda k=k: DeathFilter(transport_mode=modes[k % 5])), _accepted(lambda k=k: row_id(f"{k / 4}")),
        )
        for k in keys
    ]
    return spark.createDataFrame(rows, "k int, year boolean, location boolean, day boolean, place_type boolean, mode boolean, whole boolean")


@register("select 1 as one")
def constant_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT 1 AS one")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """operator, columns, has_sql of every registered query: what a published description would hold."""
    rows = [(name, f(spark, sf_dir).schema.simpleString(), name in SQL) for name, f in QUERIES.items()]
    return spark.createDataFrame(rows, "operator string, columns string, has_sql boolean")
