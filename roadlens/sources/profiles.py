"""Loading rider profiles: documents kept as they are, each once by the id inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.scalars import json_text, merged_instant
from roadlens.sources.counts import first_wins, last_id, numbered


def with_key(metadata: Column, key: Column) -> Column:
    """The document with ``id`` set to ``key``, in place of one that may be there; all other values keep
    their JSON types, since each is carried as the text it was."""
    # A map of raw JSON texts: objects, arrays, numbers and text all come back as they were written.
    held = F.map_filter(F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>"), lambda k, v: k != "id")
    entries = F.transform(F.map_entries(held), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))), F.lit("\u0001"), F.to_json(e["value"])))
    fields = F.transform(entries, lambda t: F.concat(F.regexp_extract(t, '(?s)^\\{"k":(.*)\\}\u0001', 1), F.lit(":"), F.regexp_extract(t, "(?s)\u0001(.*)$", 1)))
    return F.concat(F.lit("{"), F.array_join(F.concat(fields, F.array(F.concat(F.lit('"id":'), key.cast("string")))), ","), F.lit("}"))


def load(documents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """id, data, metadata of the profiles that are new, from texts ``document`` with their position.

    A document without id, or with id 0, is skipped; of several with the same id the first is taken; one whose
    id is in the metadata of ``existing`` is there already. Times of the document are not taken over.
    """
    keyed = documents.select("position", json_text(F.col("document"), "id").try_cast("long").alias("key"), json_text(F.col("document"), "data").alias("data"), json_text(F.col("document"), "metadata").alias("metadata"))
    new = first_wins(keyed.filter("key <> 0"), ["key"], ["position"])
    if existing is not None:
        there = existing.select(json_text(F.col("metadata"), "id").try_cast("long").alias("__key"))
        new = new.join(there, F.col("key") == F.col("__key"), "left_anti")
    return numbered(new, ["position"], last_id(existing)).select("id", "data", with_key(F.col("metadata"), F.col("key")).alias("metadata"))


def skipped(documents: DataFrame) -> DataFrame:
    """Documents that have no usable id."""
    key = json_text(F.col("document"), "id").try_cast("long")
    return documents.filter(F.coalesce(key, F.lit(0)) == 0)


def instant(metadata: Column) -> Column:
    """The date of a document with the time of its hour, as one instant's text."""
    return merged_instant(json_text(metadata, "date"), json_text(metadata, "hour"))
