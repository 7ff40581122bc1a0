"""Running loads in order: each by itself, timed and reported, with a choice of which to run."""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.plans.schemas import COUNT_DOCUMENT, TABLES, ddl
from roadlens.sources import counts, deaths, files, profiles, tables

REPORT = "task string, success boolean, seconds double, details map<string,bigint>, error string"


def run(spark: SparkSession, tasks: Mapping[str, Callable[[], Mapping[str, int]]], only: Collection[str] = (), skip: Collection[str] = ()) -> DataFrame:
    """Runs the tasks in their order and returns task, success, seconds, details, error. A task that fails does
    not keep the next one from running."""
    rows = []
    for name, task in tasks.items():
        if (only and name not in only) or name in skip:
            continue
        began = time.time()
        try:
            success, details, error = True, {k: int(v) for k, v in task().items()}, None
        except Exception as e:  # a load's failure is part of the report
            success, details, error = False, {}, f"{type(e).__name__}: {e}"[:500]
        rows.append((name, success, time.time() - began, details, error))
    return spark.createDataFrame(rows, REPORT)


def lines(report: DataFrame, width: int = 20) -> DataFrame:
    """The report as text, a line for each task with its name padded."""
    mark = F.when(F.col("success"), F.lit("ok")).otherwise(F.lit("failed"))
    return report.select(F.concat_ws(" | ", mark, F.rpad("task", width, " "), F.format_string("%.2fs", "seconds"), "error").alias("line"))


def failed(report: DataFrame) -> bool:
    """Whether the whole load counts as failed (a process would end with status 1)."""
    return not report.filter("not success").isEmpty()


def create_tables(spark: SparkSession) -> list[str]:
    """Creates the tables that are missing; running it again changes nothing."""
    for name in TABLES:
        spark.sql(ddl(name))
    return list(TABLES)


def reset(spark: SparkSession) -> None:
    """Empties the tables that are there, children first."""
    for name in reversed(TABLES):
        if spark.catalog.tableExists(name):
            spark.sql(f"TRUNCATE TABLE {name}")


# The three loads, with their counters: what was made, what was there already, what was turned away.


def load_deaths(spark: SparkSession, folder: str, root: str, *, app_rules: bool = False) -> dict[str, int]:
    """Yearly files into the table; ``app_rules`` drops uneven rows and takes dates of any eight characters.

    The files are parsed once: typed rows are kept beside the table until they are counted, numbered and added.
    """
    rows = tables.keep(spark, root, deaths.converted(files.read_years(spark, folder, drop_uneven=app_rules), strict=not app_rules))
    there = tables.read(spark, root, "traffic_deaths")
    good = deaths.accepted(rows)
    new = deaths.new_years(good, there)
    held = rows.agg(F.count("*").alias("n"), F.count("reject").alias("bad")).first()
    created = new.count() if there is not None else held["n"] - held["bad"]
    deaths.write(deaths.with_keys(new, deaths.batch_mark(), counts.last_id(there)), f"{root.rstrip('/')}/traffic_deaths")
    tables.settle(spark, root)
    return {"created": created, "skipped": held["n"] - held["bad"] - created, "errors": held["bad"]}


COUNT_TABLES = ("counting_locations", "counting_events", "counting_sessions", "session_movements")


def load_counts(spark: SparkSession, path: str, root: str, *, lines: bool = False) -> dict[str, int]:
    """Counts documents (an array, or one a line) into their four tables.

    All new rows are written beside the tables before the first is added, so that each of them is worked out from
    the tables as they were; a run that dies after that is completed by the next one.
    """
    tables.settle(spark, root)
    documents = files.read_documents(spark, path, COUNT_DOCUMENT, lines=lines)
    made = counts.load(documents, *(tables.read(spark, root, name) for name in COUNT_TABLES), kept=lambda rows: tables.keep(spark, root, rows))
    counters = {name: rows.count() for name, rows in tables.stage(spark, root, dict(zip(COUNT_TABLES, made, strict=True))).items()}
    tables.settle(spark, root)
    return counters | {"skipped": documents.filter(~counts.valid_coordinates()).count()}


def load_profiles(spark: SparkSession, path: str, root: str, *, lines: bool = False) -> dict[str, int]:
    tables.settle(spark, root)
    documents = files.read_documents(spark, path, lines=lines)
    new = profiles.load(documents, tables.read(spark, root, "cyclist_profiles"))
    created = tables.stage(spark, root, {"cyclist_profiles": new})["cyclist_profiles"].count()
    tables.settle(spark, root)
    return {"created": created, "skipped": documents.count() - created}
