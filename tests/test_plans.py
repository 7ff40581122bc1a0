"""Plans are the ones wanted: pruned partitions and columns, pushed filters, one scan, no Python."""

import re

import pytest
from pyspark.sql import functions as F

from roadlens.operators import counting, mortality
from roadlens.plans.params import DeathFilter, EventFilter
from roadlens.plans.schemas import TRAFFIC_DEATHS
from roadlens.sources import deaths


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "traffic_deaths")
    rows = spark.range(3000).select(
        (F.col("id") % 900 + 2600000).cast("int").alias("codmunocor"),
        F.concat(F.lit("V"), F.lpad((F.col("id") % 100).cast("string"), 2, "0")).alias("causabas"),
        F.make_date(F.lit(2019) + F.col("id").cast("int") % 3, F.lit(1), F.lit(1)).alias("dtobito"),
        (F.lit(2019) + F.col("id") % 3).cast("int").alias("data_year"),
        F.lit(None).cast("int").alias("contador"),
    )
    full = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in TRAFFIC_DEATHS.fields if f.name not in (*rows.columns, "id", "import_batch", "created_at", "updated_at")])
    deaths.write(deaths.with_keys(full, "test"), path)
    return spark.read.schema(TRAFFIC_DEATHS).parquet(path)


def columns_read(text):
    return [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_a_year_reads_a_year(stored):
    text = plan(mortality.summary(stored, DeathFilter(year=2020)))
    assert "PartitionFilters: [isnotnull(data_year" in text and columns_read(text) == [[]]


def test_city_and_prefix_reach_the_scan(stored):
    text = plan(mortality.time_series(stored, DeathFilter(start_year=2019, end_year=2020, city_code=2600007, transport_mode="cyclist")))
    assert "EqualTo(codmunocor,2600007)" in text and "StringStartsWith(causab" in text
    assert columns_read(text) == [["codmunocor", "causabas"]] and "data_year" in text.split("PartitionFilters")[1]


@pytest.mark.parametrize("report", [mortality.cyclists, mortality.by_city, mortality.by_transport_mode, mortality.stats, mortality.load_check, mortality.cube, mortality.stats_report])
def test_reports_scan_once_without_python(stored, report):
    text = plan(report(stored))
    assert text.count("FileScan") == 1 and not re.search("Python|Arrow|CartesianProduct", text)
    assert all(set(c) <= {"codmunocor", "codmunres", "causabas"} for c in columns_read(text))


def test_aggregates_combine_before_the_shuffle(stored):
    text = plan(mortality.by_city(stored))
    assert text.index("keys=[codmunocor") and "partial_count" in text


def test_events_join_locations_only_for_a_city(spark):
    events = spark.createDataFrame([], "id int, location_id int, counting_date date")
    places = spark.createDataFrame([], "id int, city string")
    assert "Join" not in events.transform(lambda e: counting.events(e, places))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in counting.events(events, places, EventFilter(city="Recife"))._jdf.queryExecution().analyzed().toString()
