"""Look-ups and analyses over the hierarchy location, event, session, movement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.scalars import distance_m, json_int, json_text
from roadlens.operators.predicates import at_least, at_most, equal, keep
from roadlens.plans.params import EventFilter, NotFound, row_id

METRES_A_DEGREE = 111_195.0


def by_id(table: DataFrame, wanted: object) -> DataFrame:
    """The row with an id, if there is one; the filter reaches the scan."""
    return table.filter(F.col("id") == row_id(wanted)).limit(1)


def get(table: DataFrame, wanted: object) -> DataFrame:
    """The row with an id; NotFound if there is none."""
    found = by_id(table, wanted)
    if found.isEmpty():
        raise NotFound
    return found


def locations(table: DataFrame, city: str | None = None) -> DataFrame:
    return keep(table, equal("city", city))


def events(table: DataFrame, places: DataFrame, params: EventFilter = EventFilter()) -> DataFrame:
    """Events by location, city and days (both included), latest first; locations are joined only for a city,
    and then there is no order. Which side is broadcast is for the optimizer to see from their sizes."""
    rows = keep(table, equal("location_id", params.location_id), at_least("counting_date", params.start_date), at_most("counting_date", params.end_date))
    if not params.city:
        return rows.orderBy(F.desc("counting_date"))
    there = places.filter(F.col("city") == params.city).select(F.col("id").alias("__place"))
    return rows.join(there, F.col("location_id") == F.col("__place")).select(*rows.columns)


def children(parent: DataFrame, child: DataFrame, key: str, wanted: object, *order: str) -> DataFrame:
    """A parent's rows in the child table; NotFound without the parent, no rows without children."""
    get(parent, wanted)
    return child.filter(F.col(key) == row_id(wanted)).orderBy(*order)


def events_of_location(places: DataFrame, table: DataFrame, wanted: object) -> DataFrame:
    get(places, wanted)
    return table.filter(F.col("location_id") == row_id(wanted)).orderBy(F.desc("counting_date"))


def sessions_of_event(table: DataFrame, sessions: DataFrame, wanted: object) -> DataFrame:
    return children(table, sessions, "event_id", wanted, "start_time")


def movements_of_session(sessions: DataFrame, movements: DataFrame, wanted: object) -> DataFrame:
    return children(sessions, movements, "session_id", wanted, "id")


def with_children(parents: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Every parent with the number of its children, so that none are told from no parent."""
    counted = child.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n_children"))
    return parents.join(counted, F.col("id") == F.col("__key"), "left").drop("__key").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def totals_per_location(places: DataFrame, table: DataFrame) -> DataFrame:
    """id, name, total_cyclists: events are summed by location before they meet the names."""
    summed = table.groupBy(F.col("location_id").alias("__place")).agg(F.sum("total_cyclists").cast("long").alias("total_cyclists"))
    return places.select("id", "name").join(summed, F.col("id") == F.col("__place")).drop("__place")


def peak_hours(sessions: DataFrame) -> DataFrame:
    """session_label, avg_cyclists, max_cyclists, the busiest first."""
    found = sessions.groupBy("session_label").agg(F.avg("total_cyclists").alias("avg_cyclists"), F.max("total_cyclists").alias("max_cyclists"))
    return found.orderBy(F.desc("avg_cyclists"), "session_label")


def events_in_city_and_year(table: DataFrame, places: DataFrame, city: str, year: int) -> DataFrame:
    """The year as a range of days, which the scan can use."""
    days = F.col("counting_date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))
    return events(table.filter(days), places, EventFilter(city=city))


def characteristic(sessions: DataFrame, *names: str) -> DataFrame:
    """id and counted characteristics out of the JSON document, as whole numbers."""
    return sessions.select("id", *[json_int(F.col("characteristics"), n).alias(n) for n in names])


def sessions_above(sessions: DataFrame, name: str, least: int) -> DataFrame:
    return sessions.filter(json_int(F.col("characteristics"), name) > least)


def metropolitan(places: DataFrame) -> DataFrame:
    return places.filter(json_text(F.col("metadata"), "is_rmr") == "true")


def within_radius(places: DataFrame, latitude: float, longitude: float, metres: float) -> DataFrame:
    """Places within a distance, with ``distance_m``: a box of degrees, which a scan can use, comes first.

    The box is a little wide, and spans all longitudes where the circle holds a pole or meets the date line.
    """
    import math

    reach = metres / METRES_A_DEGREE * 1.001
    box = [F.col("latitude").between(latitude - reach, latitude + reach)]
    if abs(latitude) + reach < 89:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(latitude)))))
        if abs(longitude) + wide < 180:
            box.append(F.col("longitude").between(longitude - wide, longitude + wide))
    away = distance_m(F.col("latitude"), F.col("longitude"), F.lit(latitude), F.lit(longitude))
    return keep(places, *box).withColumn("distance_m", away).filter(F.col("distance_m") <= metres)


def movement_matrix(movements: DataFrame, sessions: DataFrame | None = None, table: DataFrame | None = None, location_id: int | None = None) -> DataFrame:
    """from_direction, to_direction, total, the largest first: of all movements, or of a location's.

    For a location the events are filtered first, so that each join keeps only its rows.
    """
    if location_id is not None:
        own = table.filter(F.col("location_id") == location_id).select(F.col("id").alias("__event"))
        held = sessions.join(own, F.col("event_id") == F.col("__event")).select(F.col("id").alias("__session"))
        movements = movements.join(held, F.col("session_id") == F.col("__session"))
    summed = movements.groupBy("from_direction", "to_direction").agg(F.sum("count").cast("long").alias("total"))
    return summed.orderBy(F.desc("total"), "from_direction", "to_direction")


def volume(movements: DataFrame, start: str, end: str) -> DataFrame:
    """total of the movements from one direction to another; 0 if there are none."""
    rows = movements.filter((F.col("from_direction") == start) & (F.col("to_direction") == end))
    return rows.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total"))


def commonest_movement(movements: DataFrame) -> DataFrame:
    """The pair of directions with the largest total, the first by name of equal ones: twelve rows are ordered."""
    return movement_matrix(movements).limit(1)


def busiest_entry(movements: DataFrame) -> DataFrame:
    """to_direction, total of the direction with most incoming movements."""
    summed = movements.groupBy("to_direction").agg(F.sum("count").cast("long").alias("total"))
    return summed.orderBy(F.desc("total"), "to_direction").limit(1)


def nested_events(table: DataFrame, sessions: DataFrame, movements: DataFrame) -> DataFrame:
    """Events with their sessions, and in these their movements, as arrays of structs; without any an empty array.

    Each level is folded by its parent's key before it is joined, so a row of an event is built once.
    """
    kind = f"array<{movements.schema.simpleString()}>"
    held = movements.groupBy(F.col("session_id").alias("__session")).agg(F.array_sort(F.collect_list(F.struct(*movements.columns))).alias("movements"))
    full = sessions.join(held, F.col("id") == F.col("__session"), "left").drop("__session")
    full = full.withColumn("movements", F.coalesce("movements", F.array().cast(kind)))
    folded = full.groupBy(F.col("event_id").alias("__event")).agg(F.array_sort(F.collect_list(F.struct(*full.columns))).alias("sessions"))
    out = table.join(folded, F.col("id") == F.col("__event"), "left").drop("__event")
    return out.withColumn("sessions", F.coalesce("sessions", F.array().cast(f"array<{full.schema.simpleString()}>")))


def delete_location(places: DataFrame, table: DataFrame, sessions: DataFrame, movements: DataFrame, gone: int) -> tuple[DataFrame, ...]:
    """The four tables without a location and all that hangs on it."""
    lost = table.filter(F.col("location_id") == gone).select(F.col("id").alias("__event"))
    lost_sessions = sessions.join(lost, F.col("event_id") == F.col("__event"), "left_semi").select(F.col("id").alias("__session"))
    return (
        places.filter(F.col("id") != gone),
        table.filter(F.col("location_id") != gone),
        sessions.join(lost, F.col("event_id") == F.col("__event"), "left_anti"),
        movements.join(lost_sessions, F.col("session_id") == F.col("__session"), "left_anti"),
    )
