"""Loading counts: nested documents into locations, events, sessions and movements."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadlens.functions.scalars import clock, loose_date
from roadlens.plans.schemas import MOVEMENT_KEYS


class CountTables(NamedTuple):
    locations: DataFrame
    events: DataFrame
    sessions: DataFrame
    movements: DataFrame


def valid_coordinates() -> Column:
    x, y = F.col("coordinates.x"), F.col("coordinates.y")
    return F.coalesce((x != 0) & (y != 0), F.lit(False))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by ``order``: a minimum, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    folded = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return folded.select(*keys, *[F.col("__first")[c].alias(c) for c in rest])


#: Values of the first order column whose rows are numbered together.
KEY_BLOCK = 10_000


#: Up to so many new events are told to all readers of the documents; beyond that, both are shuffled.
BROADCAST_EVENTS = 500_000


def numbered(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """``id`` from ``start`` + 1 in the given order, whose first column is a whole number.

    Rows are numbered within blocks of KEY_BLOCK values of that column and shifted by the blocks before: no task
    orders all rows, and the window without a key sees one row a block. Ids are int, as the tables declare
    them; a table that outgrows them ends in an error and not in repeated ids.
    """
    dealt = rows.withColumn("__block", F.floor(F.col(order[0]) / KEY_BLOCK))
    sizes = dealt.groupBy("__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(F.col("__block").alias("__shifted"), before.alias("__before"))
    placed = dealt.withColumn("__within", F.row_number().over(W.partitionBy("__block").orderBy(*order)))
    joined = placed.join(shifts, F.col("__block") == F.col("__shifted"))
    return joined.withColumn("id", (F.lit(start) + F.col("__before") + F.col("__within")).cast("int")).drop("__block", "__shifted", "__before", "__within")


def last_id(table: DataFrame | None) -> int:
    return 0 if table is None else table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def session_totals(sessions: Column) -> dict[str, Column]:
    """Sum and maximum of the sessions' totals, first start and last end: folds over the array, no explosion."""
    totals = F.transform(sessions, lambda s: s["total_cyclists"])
    return {
        "total_cyclists": F.aggregate(totals, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))),
        "max_hour_cyclists": F.array_max(totals),
        "start_time": clock(F.try_element_at(sessions, F.lit(1))["start_time"], "00:00:00"),
        "end_time": clock(F.try_element_at(sessions, F.lit(-1))["end_time"], "23:59:59"),
    }


def unpivot_movements(sessions: DataFrame, counts: str = "quantitative", key: str = "id") -> DataFrame:
    """key, from_direction, to_direction, count of the movements that happened, from a column for each pair."""
    pairs = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(k.split("_"), ("from_direction", "to_direction"), strict=True)], F.col(f"{counts}.{k}").alias("count")) for k in MOVEMENT_KEYS])
    return sessions.select(key, F.posexplode(pairs).alias("__place", "m")).select(key, "__place", "m.*").filter("count > 0")


def unpivot_entries(rows: DataFrame, column: str, key: str = "id") -> DataFrame:
    """key, from_direction, to_direction, count of every entry of a JSON object, zeros too."""
    entries = rows.select(key, F.explode(F.from_json(column, "map<string,int>")).alias("pair", "count"))
    parts = F.split("pair", "_")
    return entries.select(key, parts[0].alias("from_direction"), parts[1].alias("to_direction"), "count")


def load(
    documents: DataFrame,
    locations: DataFrame | None = None,
    events: DataFrame | None = None,
    sessions: DataFrame | None = None,
    movements: DataFrame | None = None,
    kept: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> CountTables:
    """New rows of the four tables from documents (see ``schemas.COUNT_DOCUMENT``) with their position.

    Documents without coordinates, or with a zero one, are skipped. Locations are told by name, and the first
    document of one makes it, sessions or not. A document without sessions makes no event; of several of a
    location and day the first makes it, and brings its sessions. What is already in ``locations`` and
    ``events`` is used, and neither made anew nor given more sessions. Ids go on behind the largest of each table.
    ``kept`` may write what several tables are made from, so that documents are read once. Which documents make events
    is told without their sessions; only those of new events are fetched.
    """
    valid = documents.filter(valid_coordinates())
    flat = valid.select(
        "position",
        F.col("metadata.name").alias("name"),
        F.col("metadata.city.name").alias("city"),
        F.col("metadata.city.state").alias("state"),
        F.col("coordinates.y").cast("decimal(10,7)").alias("latitude"),
        F.col("coordinates.x").cast("decimal(10,7)").alias("longitude"),
        F.to_json(
            F.struct(
                F.col("metadata.city.id").alias("ibge_city_id"),
                F.col("metadata.city.full_state").alias("state_full"),
                F.col("metadata.city.rmr").alias("is_rmr"),
                F.col("metadata.directions").alias("directions"),
            )
        ).alias("metadata"),
        loose_date(F.col("metadata.date")).alias("counting_date"),
        F.coalesce(F.size("data.sessions") > 0, F.lit(False)).alias("counted"),
        F.col("data.sessions").alias("sessions"),
    )
    flat = kept(flat)
    made = first_wins(flat.select("position", "name", "city", "state", "latitude", "longitude", "metadata"), ["name"], ["position"])
    if locations is not None:
        made = made.join(locations.select(F.col("name").alias("__name")), F.col("name") == F.col("__name"), "left_anti")
    made = kept(numbered(made, ["position"], last_id(locations))).select("id", "name", "city", "state", "latitude", "longitude", "metadata")
    named = made.select(F.col("id").alias("location_id"), F.col("name").alias("__name"))
    if locations is not None:
        named = named.unionByName(locations.select(F.col("id").alias("location_id"), F.col("name").alias("__name")))

    held = flat.filter("counted").select("position", "name", "counting_date").join(named, F.col("name") == F.col("__name"))
    first = first_wins(held.select("position", "location_id", "counting_date"), ["location_id", "counting_date"], ["position"])
    if events is not None:
        there = events.select(F.col("location_id").alias("__place"), F.col("counting_date").alias("__day"))
        first = first.join(there, (F.col("location_id") == F.col("__place")) & (F.col("counting_date") == F.col("__day")), "left_anti")
    first = kept(numbered(first, ["position"], last_id(events))).withColumnRenamed("position", "__first")
    few = first.limit(BROADCAST_EVENTS + 1).count() <= BROADCAST_EVENTS
    new = flat.select("position", "sessions").join(F.broadcast(first) if few else first, F.col("position") == F.col("__first"))
    new = kept(new.select("id", "location_id", "counting_date", "sessions", *[c.alias(n) for n, c in session_totals(F.col("sessions")).items()]))
    event_columns = ["id", "location_id", "counting_date", "start_time", "end_time", "total_cyclists", "max_hour_cyclists"]

    spread = new.select(F.col("id").alias("event_id"), F.posexplode("sessions").alias("__place", "s"))
    held_sessions = kept(numbered(spread.select("event_id", "__place", "s.*"), ["event_id", "__place"], last_id(sessions)))
    moved = unpivot_movements(held_sessions).withColumnRenamed("id", "session_id")
    moved = numbered(moved, ["session_id", "__place"], last_id(movements))
    stamped = held_sessions.select(
        "id",
        "event_id",
        F.col("session").alias("session_label"),
        F.try_to_timestamp("start_time").cast("timestamp_ntz").alias("start_time"),
        F.try_to_timestamp("end_time").cast("timestamp_ntz").alias("end_time"),
        "total_cyclists",
        F.to_json("characteristics").alias("characteristics"),
    )
    return CountTables(made, new.select(*event_columns), stamped, moved.select("id", "session_id", "from_direction", "to_direction", "count"))
