"""Registered queries of the sources and loads: raw files are written from the test tables, read and loaded by the
library, and held against SQL that tells the same from the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.catalogue import register
from roadlens.functions import scalars as S
from roadlens.plans.schemas import MOVEMENT_KEYS
from roadlens.sources import counts, deaths, files, loading, profiles, tables


def scratch(spark: SparkSession) -> str:
    """A new folder: in the shared one that the cluster names, or on this machine if all tasks run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="roadlens-")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/ingest-{uuid.uuid4().hex}"


# Mortality files

#: Text of a raw death record, in an expression that Spark and the SQL of the checks read alike; ``day`` is DDMMYYYY.
_RAW = {
    "contador": "cast(l_orderkey * 10 + l_linenumber as varchar(20)) || case when l_linenumber % 3 = 0 then 'abc' else '' end",
    "dtobito": "case l_partkey % 13 when 0 then 'NA' when 1 then '31022020' when 2 then '1012020' when 3 then ' ' || day || ' ' when 4 then '01132020' else day end",
    "causabas": "case when l_suppkey % 11 = 0 then '' else 'V' || lpad(cast(l_partkey % 100 as varchar(2)), 2, '0') end",
    "idade": "case when l_linenumber = 3 then 'x' else cast(cast(l_quantity as int) as varchar(10)) end",
    "codmunocor": "case when l_partkey % 7 = 0 then 'NA' else cast(2600000 + l_suppkey as varchar(20)) end",
    "linhaa": "'a, \"b\" ' || l_returnflag",
}
#: What becomes of it.
_DEATH_SQL = f"""with r as (select *, lpad(cast(day(l_shipdate) as varchar(2)), 2, '0') || lpad(cast(month(l_shipdate) as varchar(2)), 2, '0') || cast(year(l_shipdate) as varchar(4)) as day,
    cast(year(l_shipdate) as int) as data_year from lineitem),
  t as (select {", ".join(f"{e} as {c}" for c, e in _RAW.items())}, day, data_year, l_shipdate, l_partkey, l_orderkey, l_linenumber, l_quantity, l_suppkey from r),
  d as (select cast(l_orderkey * 10 + l_linenumber as int) as contador, case when l_partkey % 13 in (0, 1, 2, 4) then null else cast(l_shipdate as date) end as dtobito, nullif(causabas, '') as causabas,
    case when l_linenumber = 3 then null else cast(l_quantity as int) end as idade, case when l_partkey % 7 = 0 then null else cast(2600000 + l_suppkey as int) end as codmunocor, linhaa, data_year,
    case when l_partkey % 13 = 0 then 'dtobito missing' when causabas = '' then 'causabas missing' when l_partkey % 13 in (1, 2, 4) then 'dtobito is no date' end as reject from t)"""


def death_files(spark: SparkSession, sf_dir: str, years: str = "true") -> str:
    """The folder of a file a year, quoted and with a header, of the raw records."""
    rows = A.table(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "ddMMyyyy")).withColumn("year", F.year("l_shipdate")).filter(years)
    raw = rows.select("year", *[F.expr(e).alias(c.upper()) for c, e in _RAW.items()])
    folder = scratch(spark)
    raw.repartition("year").write.partitionBy("year").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{folder}/raw")
    # The yearly name is that of a file: each year's is moved to it.
    store, source = tables._store(spark, f"{folder}/raw")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for year in store.listStatus(source):
        if year.isDirectory():
            for part in store.listStatus(year.getPath()):
                if part.getPath().getName().endswith(".csv"):
                    store.rename(part.getPath(), path(f"{folder}/mortes_transito_{year.getPath().getName().removeprefix('year=')}.csv"))
    store.delete(source, True)
    return folder


_DEATH_COLUMNS = ("contador", "dtobito", "causabas", "idade", "codmunocor", "linhaa", "data_year")


@register(f"{_DEATH_SQL} select {', '.join(_DEATH_COLUMNS)} from d where reject is null")
def death_files_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deaths.accepted(deaths.converted(files.read_years(spark, death_files(spark, sf_dir)))).select(*_DEATH_COLUMNS)


@register(f"{_DEATH_SQL} select contador, reject from d where reject is not null")
def death_files_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deaths.rejected(deaths.converted(files.read_years(spark, death_files(spark, sf_dir)))).select("contador", "reject")


@register("select l_orderkey, l_linenumber, case when l_partkey % 13 < 5 then null else cast(l_shipdate as date) end as day from lineitem")
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of any eight characters, untrimmed: text with blanks around it is no date."""
    rows = A.table(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "ddMMyyyy"))
    return rows.select("l_orderkey", "l_linenumber", S.compact_date(F.expr(_RAW["dtobito"]), strict=False).alias("day"))


@register("select cast(n_nationkey as varchar) as id, n_name as name, cast(n_regionkey as varchar) as region from nation where n_nationkey % 5 not in (1, 2)")
def uneven_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a field too few or too many are dropped where that is asked for."""
    line = F.concat_ws(",", "n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('"')), F.when(F.col("n_nationkey") % 5 != 1, F.col("n_regionkey")), F.when(F.col("n_nationkey") % 5 == 2, F.lit("more")))
    rows = A.table(spark, sf_dir, "nation").select(line.alias("value"), F.lit(1).alias("place"))
    head = spark.createDataFrame([("ID,NAME,REGION", 0)], "value string, place int")
    folder = scratch(spark)
    head.unionByName(rows).coalesce(1).sortWithinPartitions("place").select("value").write.text(folder)
    return files.read_csv(spark, folder, drop_uneven=True).select("id", "name", "region")


@register("select n_nationkey as id, n_name as name, case when n_nationkey % 5 <> 1 then cast(n_regionkey as varchar) end as region from nation")
def uneven_rows_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otherwise short rows are filled with null and long ones cut."""
    line = F.concat_ws(",", "n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('"')), F.when(F.col("n_nationkey") % 5 != 1, F.col("n_regionkey")), F.when(F.col("n_nationkey") % 5 == 2, F.lit("more")))
    rows = A.table(spark, sf_dir, "nation").select(line.alias("value"), F.lit(1).alias("place"))
    head = spark.createDataFrame([("ID,NAME,REGION", 0)], "value string, place int")
    folder = scratch(spark)
    head.unionByName(rows).coalesce(1).sortWithinPartitions("place").select("value").write.text(folder)
    return files.read_csv(spark, folder).select(F.col("id").cast("int").alias("id"), "name", "region")


@register(f"{_DEATH_SQL} select data_year, count(*) as n, count(distinct contador) as records, cast(sum(idade) as bigint) as ages, true as ids_unique from d where reject is null group by data_year")
def deaths_loaded_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some years first, then all: what is stored has every year once, with ids of its own."""
    root = scratch(spark)
    loading.load_deaths(spark, death_files(spark, sf_dir, "year in (1996, 1998)"), root)
    loading.load_deaths(spark, death_files(spark, sf_dir), root)
    stored = tables.read(spark, root, "traffic_deaths")
    total, most = stored.agg(F.count_distinct("id"), F.max("id")).first()
    unique = F.lit(total == most == stored.count())
    return stored.groupBy("data_year").agg(F.count("*").alias("n"), F.count_distinct("contador").alias("records"), F.sum("idade").alias("ages")).withColumn("ids_unique", unique)


@register(f"{_DEATH_SQL}, y as (select data_year, reject from d) select 'created' as counter, count(*) as n from y where reject is null and data_year not in (1996, 1998) "
          "union all select 'skipped', count(*) from y where reject is null and data_year in (1996, 1998) union all select 'errors', count(*) from y where reject is not null")  # fmt: skip
def death_load_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second of two loads tells: made, there already, turned away."""
    root = scratch(spark)
    loading.load_deaths(spark, death_files(spark, sf_dir, "year in (1996, 1998)"), root)
    found = loading.run(spark, {"deaths": lambda: loading.load_deaths(spark, death_files(spark, sf_dir), root)})
    return found.select(F.explode("details").alias("counter", "n"))


# Counts documents: an order is a document of its customer's place, its lines are sessions.


_BACKWARDS = MOVEMENT_KEYS[::-1]


def order_numbers(lines: DataFrame) -> DataFrame:
    """Of each order its lines' numbers, quantities and places of their pairs of directions, in order.

    Lines are dealt by their order as they are read: lists made before that hold hardly more than a line each, and
    their sort takes memory that grows with the files' splits.
    """
    start = F.col("l_suppkey") % 4
    pair = F.concat_ws("_", A.direction(start), A.direction((start + 1 + F.col("l_partkey") % 3) % 4))
    numbers = lines.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("n"), F.array_position(F.array(*map(F.lit, _BACKWARDS)), pair).cast("int").alias("pair"))
    return numbers.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "n", "pair"))).alias("numbers"))


def count_documents(spark: SparkSession, sf_dir: str, which: str = "true") -> str:
    """Files of documents, a line each, in the order of their keys from file to file. The place with key 5 has a zero
    coordinate. Sessions are three numbers until their order's document is written, and no task orders all documents."""
    hour = lambda line, n: F.concat(F.lit("2013-03-25T"), F.lpad((line + n).cast("string"), 2, "0"), F.lit(":00:00"))
    session = lambda s: F.struct(
        s["l_linenumber"].alias("l_linenumber"), s["n"].alias("total_cyclists"), hour(s["l_linenumber"], 5).alias("start_time"), hour(s["l_linenumber"], 6).alias("end_time"), F.concat(F.lit("s"), s["l_linenumber"]).alias("session"),
        F.struct(*[F.when(s["pair"] == _BACKWARDS.index(k) + 1, s["n"]).otherwise(0).alias(k) for k in MOVEMENT_KEYS]).alias("quantitative"), F.struct(F.lit(1).alias("helmet")).alias("characteristics"),
    )
    held = order_numbers(A.table(spark, sf_dir, "lineitem"))
    orders = A.table(spark, sf_dir, "orders").filter(which).join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    placed = orders.select("o_orderkey", "o_custkey", "o_orderdate", "numbers").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    key = (F.col("o_custkey") % A.PLACES).cast("int")
    date = F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    document = F.struct(
        F.struct((F.lit(-34.0) - key).alias("x"), (key - 5.0).alias("y")).alias("coordinates"),
        F.struct(F.concat(F.lit("place "), key).alias("name"), date.alias("date"), F.struct(key.alias("id"), F.lit("Recife").alias("name"), F.lit("PE").alias("state"), F.lit(True).alias("rmr")).alias("city")).alias("metadata"),
        F.struct(F.coalesce(F.transform("numbers", session), F.array()).alias("sessions")).alias("data"),
    )
    folder = scratch(spark)
    placed.select(F.to_json(document).alias("value")).write.option("compression", "gzip").text(folder)
    return folder


#: The documents that make events, if those of even keys are loaded first: with sessions, at places with coordinates,
#: the first of a place and day.
_CHOSEN = f"""o as (select distinct o_orderkey as k, o_custkey % {A.PLACES} as p, cast(o_orderdate as date) as day from orders join lineitem on o_orderkey = l_orderkey where o_custkey % {A.PLACES} <> 5),
  c as (select min(case when k % 2 = 0 then k end) as even, min(k) as first, p, day from o group by p, day),
  e as (select coalesce(even, first) as k, p, day from c),
  ls as (select l_orderkey, l_linenumber, cast(l_quantity as int) as q from lineitem)"""


def _counts_stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables after the even documents were loaded, and then all of them."""
    root = scratch(spark)
    for which in ("o_orderkey % 2 = 0", "true"):
        loading.load_counts(spark, count_documents(spark, sf_dir, which), root, lines=True)
    return {name: tables.read(spark, root, name) for name in loading.COUNT_TABLES}


@register(f"""with {_CHOSEN} select 'place ' || p as name, day as counting_date, cast(sum(q) as int) as total_cyclists, max(q) as max_hour_cyclists,
    lpad(cast(min(l_linenumber) + 5 as varchar), 2, '0') || ':00:00' as start_time, lpad(cast(max(l_linenumber) + 6 as varchar), 2, '0') || ':00:00' as end_time,
    count(*) as n_sessions, cast(sum(case when q > 0 then 1 else 0 end) as bigint) as n_movements, cast(sum(q) as bigint) as moved
    from e join ls on k = l_orderkey group by k, p, day""")  # fmt: skip
def counts_load_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored, each with its place, and what its sessions and their movements add up to."""
    stored = _counts_stored(spark, sf_dir)
    places, events, sessions, moves = (stored[n] for n in loading.COUNT_TABLES)
    moved = moves.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("count").alias("q"))
    held = sessions.join(moved, F.col("id") == F.col("session_id"), "left").groupBy("event_id").agg(F.count_distinct("id").alias("n_sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_movements"), F.coalesce(F.sum("q"), F.lit(0)).alias("moved"))
    named = events.join(places.select(F.col("id").alias("p"), "name"), F.col("location_id") == F.col("p")).join(held, F.col("id") == F.col("event_id"))
    return named.select("name", "counting_date", "total_cyclists", "max_hour_cyclists", "start_time", "end_time", "n_sessions", "n_movements", "moved")


@register(f"""with {_CHOSEN}, n as (select 'counting_locations' as name, count(distinct o_custkey % {A.PLACES}) as n from orders where o_custkey % {A.PLACES} <> 5
    union all select 'counting_events', count(*) from e union all select 'counting_sessions', count(*) from e join ls on k = l_orderkey
    union all select 'session_movements', count(*) from e join ls on k = l_orderkey where q > 0) select name, n, n as ids, cast(n as int) as last_id from n""")  # fmt: skip
def count_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each table rows, different ids and the last one: no id is used twice, and none left out."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("id").alias("last_id")) for name, df in _counts_stored(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("select from_direction, to_direction, cast(sum(cnt) as int) as cnt, event_id from mov group by 1, 2, 4", "mov")
def unpivot_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a JSON object an event, whatever its keys are."""
    pair = F.concat_ws("_", "from_direction", "to_direction")
    summed = A.movements(spark, sf_dir).groupBy("event_id", pair.alias("k")).agg(F.sum("count").cast("int").alias("n"))
    wide = summed.groupBy("event_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "n")))).alias("moves"))
    return counts.unpivot_entries(wide, "moves", "event_id").select("event_id", "from_direction", "to_direction", F.col("count").alias("cnt"))


@register("select event_id, cast(ts as date) as day from events")
def loose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written without leading zeros, or as instants."""
    plain = F.concat_ws("-", F.year("ts"), F.month("ts"), F.dayofmonth("ts"))
    text = F.when(F.col("event_id") % 2 == 0, plain).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return A.table(spark, sf_dir, "events").select("event_id", S.loose_date(text).alias("day"))


# Profile documents


def profile_documents(spark: SparkSession, sf_dir: str, which: str = "true") -> str:
    """A document for each event, with its user's number as id: every ninth has none, every tenth 0."""
    rows = A.table(spark, sf_dir, "events").filter(which)
    key = F.when(F.col("event_id") % 9 == 0, F.lit(None)).when(F.col("event_id") % 10 == 0, F.lit(0)).otherwise(F.col("user_id"))
    meta = F.struct(F.lit(-1).alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("hour"))
    document = F.to_json(F.struct(key.alias("id"), F.struct("event_id", "event_type").alias("data"), meta.alias("metadata")))
    folder = scratch(spark)
    rows.select("event_id", document.alias("value")).coalesce(1).sortWithinPartitions("event_id").select("value").write.text(folder)
    return folder


@register("""with v as (select * from events where event_id % 9 <> 0 and event_id % 10 <> 0 and user_id <> 0), e as (select min(case when event_id % 2 = 1 then event_id end) as odd, min(event_id) as first, user_id from v group by user_id),
  k as (select coalesce(odd, first) as event_id, user_id, odd is null as later from e)
  select cast(row_number() over (order by later, k.event_id) as int) as id, cast(k.user_id as int) as key, cast(k.event_id as int) as event, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') as instant
  from k join events on k.event_id = events.event_id""")  # fmt: skip
def profiles_loaded_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents of a user the first is stored, under the number that the document bears."""
    root = scratch(spark)
    for which in ("event_id % 2 = 1", "true"):
        loading.load_profiles(spark, profile_documents(spark, sf_dir, which), root, lines=True)
    stored = tables.read(spark, root, "cyclist_profiles")
    data, meta = F.col("data"), F.col("metadata")
    return stored.select("id", S.json_int(meta, "id").alias("key"), S.json_int(data, "event_id").alias("event"), S.json_text(data, "event_type").alias("event_type"), profiles.instant(meta).alias("instant"))


@register("select count(*) as n from events where event_id % 9 = 0 or event_id % 10 = 0 or user_id = 0")
def profiles_without_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.skipped(files.read_documents(spark, profile_documents(spark, sf_dir), lines=True)).agg(F.count("*").alias("n"))


# Manifest and checksums


@register("select r_name as dataset, 's3' as storage, 'b' as bucket, n_name as name, 'k/' || n_name as key, cast(n_nationkey as bigint) as size, 'sha256:' || sha256(n_name) as checksum from nation join region on n_regionkey = r_regionkey")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a manifest lists: regions are datasets, nations their files."""
    nations = A.table(spark, sf_dir, "nation").join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    file = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("k/"), "n_name").alias("key"), F.col("n_nationkey").cast("long").alias("size"), S.sha256_mark(F.col("n_name").cast("binary")).alias("checksum"))
    sets = nations.groupBy("r_name").agg(F.struct(F.lit("s3").alias("storage"), F.struct(F.lit("b").alias("bucket"), F.lit("k").alias("prefix"), F.collect_list(file).alias("files")).alias("s3")).alias("d"))
    whole = sets.agg(F.to_json(F.struct(F.lit("1.0").alias("version"), F.map_from_entries(F.collect_list(F.struct("r_name", "d"))).alias("datasets"))).alias("value"))
    folder = scratch(spark)
    whole.write.text(folder)
    return files.manifest(spark, folder).drop("version")


@register("select cast(length(n_name) + 1 as bigint) as size, 'sha256:' || sha256(n_name || chr(10)) as checksum from nation")
def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and checksum of whole files: one for each nation, with its name on a line."""
    folder = scratch(spark)
    A.table(spark, sf_dir, "nation").select("n_name").coalesce(1).write.option("maxRecordsPerFile", 1).text(folder)
    return files.checksums(spark, [folder]).select("size", "checksum")


@register("select event_id from events where cast(json_extract_string(props, '$.k') as int) = 5")
def json_containment_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment at depth, and among the elements of an array; text "5" is not the number."""
    rows = A.table(spark, sf_dir, "events")
    k = S.json_int(F.col("props"), "k")
    document = F.to_json(F.struct(F.struct(F.struct(k.alias("k"), k.cast("string").alias("text")).alias("inner"), F.array(F.lit(1), k).alias("list")).alias("outer")))
    held = S.json_contains(F.col("doc"), outer={"inner": {"k": 5}, "list": [5]}) & ~S.json_contains(F.col("doc"), outer={"inner": {"text": 5}})
    return rows.select("event_id", document.alias("doc")).filter(held).select("event_id")
