"""The stored tables: Parquet folders, or a database over JDBC."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.plans.schemas import TABLES


def read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table under its schema, without looking into its files for one; None if nothing was written yet."""
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def append(rows: DataFrame, root: str, name: str) -> None:
    """Adds rows under the table's columns and types; columns that rows lack are null."""
    schema = TABLES[name]
    missing = {f.name: None for f in schema.fields if f.name not in rows.columns}
    full = rows.selectExpr("*", *[f"cast(null as {schema[n].dataType.simpleString()}) as `{n}`" for n in missing])
    full.selectExpr(*[f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in schema.fields]).write.mode("append").parquet(f"{root.rstrip('/')}/{name}")


STAGED = "_staged"
READY = "_READY"


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path in its own words."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def stage(spark: SparkSession, root: str, batch: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Writes rows for several tables beside them, and marks them as whole once all are there. ``settle`` adds them.

    New rows are worked out from what the tables hold, so none may change before all rows are written. Rows
    must have ids.
    """
    folder = f"{root.rstrip('/')}/{STAGED}/{uuid.uuid4().hex}"
    for name, rows in batch.items():
        append(rows, folder, name)
    store, mark = _store(spark, f"{folder}/{READY}")
    store.create(mark).close()
    return {name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}") for name in batch}


def keep(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """``rows`` as written beside the tables, so that several later steps read them; the next ``settle`` drops them."""
    path = f"{root.rstrip('/')}/{STAGED}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def settle(spark: SparkSession, root: str) -> None:
    """Adds what was staged as a whole, and drops what was not.

    Rows whose ids a table has already are left out, so a run that died on the way can be settled again. One load
    at a time may work on a root.
    """
    store, folder = _store(spark, f"{root.rstrip('/')}/{STAGED}")
    if not store.exists(folder):
        return
    for status in store.listStatus(folder):
        batch = status.getPath()
        if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(batch, READY)):
            for held in store.listStatus(batch):
                name = held.getPath().getName()
                if name not in TABLES:
                    continue
                rows = spark.read.schema(TABLES[name]).parquet(held.getPath().toString())
                least = rows.agg(F.min("id")).first()[0]
                if least is None:
                    continue
                there = read(spark, root, name)
                if there is not None:
                    rows = rows.join(there.filter(F.col("id") >= least).select("id"), "id", "left_anti")
                append(rows, root, name)
        store.delete(batch, True)


def put(rows: DataFrame, url: str, name: str, *, batch: int = 1000, parts: int = 8, **options: str) -> None:
    """Appends rows to a table of a database: ``parts`` connections at most, ``batch`` rows a statement, each
    connection's rows in one transaction."""
    rows.coalesce(parts).write.format("jdbc").option("url", url).option("dbtable", name).option("batchsize", batch).options(**options).mode("append").save()


def jdbc(spark: SparkSession, url: str, name: str, *, key: str = "id", bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database; with bounds of its key it is read by several tasks at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
