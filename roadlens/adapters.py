"""Domain tables derived from the generated test tables, as DataFrames and as SQL with the same rows.

Deaths come from line items with their order's customer and supplier, places from suppliers, events from
orders, sessions and movements from line items, and profiles from events. The SQL runs in any ANSI engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.plans.schemas import DIRECTIONS

#: Nation keys with a named city, and the one without any; others get a code beyond the dictionary.
NAMED = {0: 2600054, 1: 2609600, 2: 2611606, 3: 2607901}
NAMELESS = 24
#: Places that events are spread over: as many as there are at the smallest scale.
PLACES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def city_code(key: Column) -> Column:
    code = F.when(key == NAMELESS, F.lit(None).cast("int"))
    for k, v in NAMED.items():
        code = code.when(key == k, F.lit(v))
    return code.otherwise(key + 2700000).cast("int")


def city_sql(key: str) -> str:
    return f"cast(case when {key} = {NAMELESS} then null " + " ".join(f"when {key} = {k} then {v}" for k, v in NAMED.items()) + f" else 2700000 + {key} end as int)"


def direction(place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DIRECTIONS)), (place + 1).cast("int"))


def direction_sql(place: str) -> str:
    return f"case {place} " + " ".join(f"when {i} then '{d}'" for i, d in enumerate(DIRECTIONS)) + " end"


def deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each join is on a key; which side is small enough to broadcast is seen at run time."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.concat(F.lit("V"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0")).alias("causabas"),
        F.col("l_shipdate").cast("date").alias("dtobito"),
        F.year("l_shipdate").cast("int").alias("data_year"),
        city_code(F.col("s_nationkey")).alias("codmunocor"),
        city_code(F.col("c_nationkey")).alias("codmunres"),
        F.col("l_quantity").cast("int").alias("idade"),
        F.col("l_returnflag").alias("sexo"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations, regions = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    joined = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").cast("int").alias("id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("city"),
        F.substring("r_name", 1, 2).alias("state"),
        (F.col("s_acctbal") / 1000).cast("decimal(10,7)").alias("latitude"),
        F.lit("-34.9").cast("decimal(10,7)").alias("longitude"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    label = F.concat(F.lpad((line + 5).cast("string"), 2, "0"), F.lit("-"), F.lpad((line + 6).cast("string"), 2, "0"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("int").alias("event_id"), label.alias("session_label"), F.col("l_quantity").cast("int").alias("total_cyclists"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions are summed before the join, so it meets a row for each event."""
    summed = sessions(spark, sf_dir).groupBy("event_id").agg(F.sum("total_cyclists").alias("total_cyclists"), F.max("total_cyclists").alias("max_hour_cyclists"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("id"), (F.col("o_custkey") % PLACES).cast("int").alias("location_id"), F.col("o_orderdate").cast("date").alias("counting_date"))
    return orders.join(summed, F.col("id") == F.col("event_id")).drop("event_id")


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with and without sessions, by what an order tells of them."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("id"), (F.col("o_custkey") % PLACES).cast("int").alias("location_id"), F.col("o_orderdate").cast("date").alias("counting_date"))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_suppkey") % 4
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("int").alias("event_id"),
        direction(start).alias("from_direction"),
        direction((start + 1 + F.col("l_partkey") % 3) % 4).alias("to_direction"),
        F.col("l_quantity").cast("int").alias("count"),
    )


def keyed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with ids: the lines of an order that share a number are one."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("total_cyclists"))
    label = F.concat(F.lpad((F.col("l_linenumber") + 5).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("l_linenumber") + 6).cast("string"), 2, "0"))
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").cast("int").alias("event_id"), label.alias("session_label"), "total_cyclists")


def keyed_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements of these sessions with ids: a line's pair of directions, summed."""
    start = F.col("l_suppkey") % 4
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("session_id"), start.alias("a"), ((start + 1 + F.col("l_partkey") % 3) % 4).alias("b"), F.col("l_quantity").cast("int").alias("n")
    )
    summed = rows.groupBy("session_id", "a", "b").agg(F.sum("n").cast("int").alias("count"))
    return summed.select((F.col("session_id") * 16 + F.col("a") * 4 + F.col("b")).alias("id"), "session_id", direction(F.col("a")).alias("from_direction"), direction(F.col("b")).alias("to_direction"), "count")


def faulty_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements with every fault that their rules name."""
    start = F.col("l_suppkey") % 4
    to = F.when(F.col("l_partkey") % 9 == 0, F.lit("up")).otherwise(direction((start + F.col("l_partkey") % 3) % 4))
    return table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 11 == 0, F.lit("down")).otherwise(direction(start)).alias("from_direction"), to.alias("to_direction"), (F.col("l_quantity") - 10).cast("int").alias("count"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("id"), F.col("props").alias("data"), F.col("props").alias("metadata"), "event_type", "user_id")


SQL = {
    "td": f"""select 'V' || lpad(cast(l_partkey % 100 as varchar(2)), 2, '0') as causabas, cast(l_shipdate as date) as dtobito,
        cast(year(l_shipdate) as int) as data_year, {city_sql("s_nationkey")} as codmunocor, {city_sql("c_nationkey")} as codmunres,
        cast(l_quantity as int) as idade, l_returnflag as sexo
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey""",
    "loc": """select cast(s_suppkey as int) as id, s_name as name, n_name as city, substr(r_name, 1, 2) as state,
        cast(s_acctbal / 1000 as decimal(10,7)) as latitude, cast(-34.9 as decimal(10,7)) as longitude
      from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "ses": """select cast(l_orderkey as int) as event_id,
        lpad(cast(5 + l_linenumber as varchar(2)), 2, '0') || '-' || lpad(cast(6 + l_linenumber as varchar(2)), 2, '0') as session_label,
        cast(l_quantity as int) as total_cyclists from lineitem""",
    "alle": f"""select cast(o_orderkey as int) as id, cast(o_custkey % {PLACES} as int) as location_id, cast(o_orderdate as date) as counting_date from orders""",
    "evt": f"""select cast(o_orderkey as int) as id, cast(o_custkey % {PLACES} as int) as location_id, cast(o_orderdate as date) as counting_date,
        cast(sum(cast(l_quantity as int)) as bigint) as total_cyclists, max(cast(l_quantity as int)) as max_hour_cyclists
      from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_custkey, o_orderdate""",
    "mov": f"""select cast(l_orderkey as int) as event_id, {direction_sql("(l_suppkey % 4)")} as from_direction,
        {direction_sql("((l_suppkey % 4 + 1 + l_partkey % 3) % 4)")} as to_direction, cast(l_quantity as int) as cnt from lineitem""",
    "kses": """select l_orderkey * 8 + l_linenumber as id, cast(l_orderkey as int) as event_id,
        lpad(cast(5 + l_linenumber as varchar(2)), 2, '0') || '-' || lpad(cast(6 + l_linenumber as varchar(2)), 2, '0') as session_label,
        cast(sum(cast(l_quantity as int)) as int) as total_cyclists from lineitem group by l_orderkey, l_linenumber""",
    "kmov": f"""select session_id * 16 + a * 4 + b as id, session_id, {direction_sql("a")} as from_direction, {direction_sql("b")} as to_direction, cast(sum(n) as int) as count
      from (select l_orderkey * 8 + l_linenumber as session_id, l_suppkey % 4 as a, (l_suppkey % 4 + 1 + l_partkey % 3) % 4 as b, cast(l_quantity as int) as n from lineitem) group by session_id, a, b""",
    "faulty": f"""select case when l_partkey % 11 = 0 then 'down' else {direction_sql("(l_suppkey % 4)")} end as from_direction,
        case when l_partkey % 9 = 0 then 'up' else {direction_sql("((l_suppkey % 4 + l_partkey % 3) % 4)")} end as to_direction, cast(l_quantity - 10 as int) as cnt from lineitem""",
    "rmr": """select cast(s_suppkey as int) as id, n_name as city, case when s_suppkey % 3 = 0 then 'true' else 'false' end as is_rmr
      from supplier join nation on s_nationkey = n_nationkey""",
    "prof": "select cast(event_id as int) as id, props as data, props as metadata, event_type, user_id from events",
}


def with_tables(query: str, *names: str) -> str:
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " " + query
