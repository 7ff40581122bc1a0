"""New yearly files as a stream: each is read once, and a year that is loaded already is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadlens.functions.scalars import blank_to_null
from roadlens.sources import deaths, tables


def yearly_files(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Text columns of the files of a folder as they come, with ``file_year``."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.readStream.schema(schema).option("header", True).csv(folder)
    year = F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\d{4})", 1).try_cast("int")
    return raw.select(*[blank_to_null(F.col(c)).alias(c.lower()) for c in columns], year.alias("file_year"))


def load_available(spark: SparkSession, folder: str, columns: list[str], root: str, checkpoint: str) -> StreamingQuery:
    """Loads what is new in ``folder`` into the table of deaths under ``root`` and ends.

    The checkpoint remembers files; the years in the table decide for each batch, so that a batch that is run
    again after a failure adds nothing twice.
    """

    def load(batch: DataFrame, epoch: int) -> None:
        loaded = tables.read(batch.sparkSession, root, "traffic_deaths")
        start = loaded.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if loaded is not None else 0
        new = deaths.new_years(deaths.accepted(deaths.converted(batch)), loaded)
        deaths.write(deaths.with_keys(new, f"{deaths.batch_mark()}-{epoch}", start), f"{root.rstrip('/')}/traffic_deaths")

    rows = yearly_files(spark, folder, columns)
    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
