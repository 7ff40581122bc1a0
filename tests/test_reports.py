"""Reports on small tables with known answers, and on the cases that decide their semantics."""

import datetime as dt
import decimal
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadlens.functions import scalars as S
from roadlens.operators import constraints, counting, mortality, predicates, profiles
from roadlens.plans.dims import CITIES, MODES, cities, modes
from roadlens.plans.params import DeathFilter, EventFilter, InvalidParameter, NotFound

DEATH = "causabas string, data_year int, codmunocor int, codmunres int"


def deaths(spark, *rows):
    """(causabas, data_year, codmunocor, n): n rows each, living where they died."""
    frame = spark.createDataFrame(list(rows), "causabas string, data_year int, codmunocor int, n int")
    return frame.select("causabas", "data_year", "codmunocor", F.col("codmunocor").alias("codmunres"), F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()


def test_totals(spark):
    d = deaths(spark, ("V10", 2022, 1, 3), ("X", 2023, 2, 4))
    assert one(mortality.summary(d)) == {"total_deaths": 7, "year": None, "message": "Total traffic deaths (all years)"}
    assert one(mortality.summary(d, DeathFilter(year=2023))) == {"total_deaths": 4, "year": 2023, "message": "Total traffic deaths in 2023"}


@pytest.mark.parametrize(("part", "whole", "want"), [(12189, 320320, 3.81), (1510, 35938, 4.2), (223, 4025, 5.54), (0, 0, 0.0), (1, 3, 33.33), (2, 3, 66.67)])
def test_percentages(spark, part, whole, want):
    assert one(spark.range(1).select(S.percent(F.lit(part), F.lit(whole)).alias("p")))["p"] == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**7), st.integers(1, 10**7)), min_size=20, max_size=60))
def test_rounding_is_exact_half_up(spark, pairs):
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", S.percent(F.col("a"), F.col("b")).alias("p"), S.mean2(F.col("a"), F.col("b")).alias("m")).collect()
    cent = decimal.Decimal("0.01")
    with decimal.localcontext() as c:
        c.prec = 60
        for r in got:
            share = decimal.Decimal(r["a"]) / r["b"]
            assert r["p"] == float((share * 100).quantize(cent, decimal.ROUND_HALF_UP))
            assert r["m"] == float(share.quantize(cent, decimal.ROUND_HALF_UP))


def test_cyclists_and_messages(spark):
    d = deaths(spark, ("V12", 2022, 261160, 1), ("V22", 2022, 261160, 3), ("V10", 2023, 5, 2))
    got = one(mortality.cyclists(d, DeathFilter(year=2022, city_code=261160)))
    assert (got["total_cyclist_deaths"], got["percentage_of_total"], got["message"]) == (1, 25.0, "Cyclist deaths in city 261160 for 2022")
    assert one(mortality.cyclists(d))["message"] == "Cyclist deaths (all years and cities)"
    assert mortality.cyclist_message(2022, None) == "Cyclist deaths in 2022" and mortality.cyclist_message(None, 5) == "Cyclist deaths in city 5"
    assert one(mortality.cyclists(d, DeathFilter(city_code=9)))["percentage_of_total"] == 0.0


def test_city_code_zero_filters_nothing_but_is_echoed(spark):
    got = one(mortality.cyclists(deaths(spark, ("V1", 2022, 5, 2)), DeathFilter(city_code=0)))
    assert (got["total_cyclist_deaths"], got["city_code"]) == (2, 0)


def test_cities_without_code_count_nowhere(spark):
    d = deaths(spark, ("V1", 2023, 2611606, 5), ("V1", 2023, 261160, 2), ("V1", 2023, 99, 2), ("V1", 2023, None, 7))
    got = [(r["rank"], r["city_code"], r["city_name"], r["total_deaths"], r["total"]) for r in mortality.by_city(d).orderBy("rank").collect()]
    assert got == [(1, 2611606, "Recife", 5, 9), (2, 99, None, 2, 9), (3, 261160, None, 2, 9)]
    report = json.loads(one(mortality.as_json(mortality.by_city_report(d, DeathFilter(year=2023))))["json"])
    assert report["cities"][0] == {"city_code": 2611606, "city_name": "Recife", "total_deaths": 5} and report["total"] == 9


def test_modes(spark):
    d = deaths(spark, ("V00", 2023, 1, 2), ("V95", 2023, 1, 9), ("V99", 2023, 1, 2), ("V452", 2023, 1, 4), ("W1", 2023, 1, 1))
    got = [(r["mode"], r["total_deaths"], r["percentage"], r["total"]) for r in mortality.by_transport_mode(d).orderBy("rank").collect()]
    assert got == [("Ocupante de automóvel", 4, 50.0, 8), ("Pedestre", 2, 25.0, 8), ("Não especificado", 2, 25.0, 8)]
    empty = one(mortality.by_transport_mode_report(d, DeathFilter(year=2020)))
    assert empty["transport_modes"] == [] and empty["total"] == 0


def test_series_is_filled_with_zeros(spark):
    d = deaths(spark, ("V1", 2021, 1, 497), ("V1", 2023, 1, 676), ("V2", 2022, 1, 497))
    got = one(mortality.time_series_report(d, DeathFilter(start_year=2021, end_year=2023)))
    assert (got["total"], got["average_per_year"]) == (1670, 556.67)
    cyc = mortality.time_series(d, DeathFilter(start_year=2020, end_year=2023, transport_mode="cyclist")).orderBy("year").collect()
    assert [(r["year"], r["total_deaths"]) for r in cyc] == [(2020, 0), (2021, 497), (2022, 0), (2023, 676)]
    reversed_ = one(mortality.time_series_report(d, DeathFilter(start_year=2023, end_year=2021)))
    assert reversed_["data"] == [] and reversed_["average_per_year"] == 0.0
    assert mortality.time_series(d, today=dt.date(2024, 5, 1)).count() == 10


def test_statistics(spark):
    totals = dict(zip(range(2015, 2024), [748, 713, 665, 630, 567, 571, 497, 497, 676], strict=True))
    got = one(mortality.stats(deaths(spark, *[("V1", y, 1, n) for y, n in totals.items()])))
    assert got == {
        "latest_year": 2023, "latest_year_deaths": 676, "previous_year_deaths": 497, "growth_percentage": 36.02, "most_violent_year": 2015, "most_violent_year_deaths": 748,
        "last_5_years_total": 2808, "last_5_years_average": 561.6, "all_time_total": 5564, "years_covered": 9, "all_time_average": 618.22,
    }


def test_statistics_of_gaps_ties_nulls_and_nothing(spark):
    gap = one(mortality.stats(deaths(spark, ("V1", 2018, 1, 3), ("V1", 2020, 1, 3))))
    assert (gap["previous_year_deaths"], gap["growth_percentage"], gap["most_violent_year"], gap["years_covered"], gap["last_5_years_average"]) == (0, 0.0, 2018, 3, 1.2)
    down = one(mortality.stats(deaths(spark, ("V1", 2019, 1, 3), ("V1", 2020, 1, 2))))
    assert down["growth_percentage"] == -33.33
    null = one(mortality.stats(deaths(spark, ("V1", 2019, 1, 3), ("V1", None, 1, 5))))
    assert (null["most_violent_year"], null["most_violent_year_deaths"], null["all_time_total"]) == (2019, 5, 8)
    tie = one(mortality.stats(deaths(spark, ("V1", 2019, 1, 5), ("V1", None, 1, 5))))
    assert tie["most_violent_year_deaths"] == 5 and tie["most_violent_year"] == 2019
    none = one(mortality.stats(spark.createDataFrame([], DEATH), today=dt.date(2024, 1, 1)))
    assert (none["latest_year"], none["years_covered"], none["most_violent_year"], none["all_time_average"]) == (2024, 10, 2024, 0.0)


def test_dimensions(spark):
    assert cities(spark).count() == len(CITIES) == 14 and modes(spark).count() == len(MODES) == 10


@pytest.mark.parametrize("bad", [{"year": 2014}, {"year": 2031}, {"year": "x"}, {"year": 2015.5}, {"location_type": "home"}, {"transport_mode": "boat"}, {"city_code": "abc"}])
def test_parameters_are_checked(bad):
    with pytest.raises(InvalidParameter):
        DeathFilter(**bad)


def test_event_parameters():
    assert EventFilter(location_id="3", start_date="2023-01-02").start_date == dt.date(2023, 1, 2)
    for bad in ({"location_id": 0}, {"start_date": "2/3/2020"}):
        with pytest.raises(InvalidParameter):
            EventFilter(**bad)


# Counting

EVENT = "id int, location_id int, counting_date date, total_cyclists int"
PLACE = "id int, name string, city string, latitude decimal(10,7), longitude decimal(10,7), metadata string"


@pytest.fixture(scope="module")
def counts(spark):
    d = decimal.Decimal
    places = spark.createDataFrame([(1, "A", "Recife", d("-8.05"), d("-34.9"), '{"is_rmr":true}'), (2, "B", "Olinda", d("-8.01"), d("-34.86"), '{"is_rmr":false}'), (3, "C", "Recife", d("-8.9"), d("-35.5"), None)], PLACE)
    events = spark.createDataFrame([(1, 1, dt.date(2023, 11, 9), 3961), (2, 1, dt.date(2023, 6, 15), 2500), (3, 2, dt.date(2023, 7, 1), 10)], EVENT)
    sessions = spark.createDataFrame([(1, 1, "06-07", 351, '{"women":10,"helmet":25}'), (2, 1, "07-08", 450, '{"women":"x"}'), (3, 2, "06-07", 5, None)], "id int, event_id int, session_label string, total_cyclists int, characteristics string")
    movements = spark.createDataFrame([(1, 1, "north", "south", 5), (2, 1, "south", "north", 7), (3, 2, "north", "south", 4), (4, 3, "east", "west", 9)], "id int, session_id int, from_direction string, to_direction string, count int")
    return places, events, sessions, movements


def ids(df):
    return [r["id"] for r in df.collect()]


def test_lists_and_lookups(counts):
    places, events, sessions, movements = counts
    assert sorted(ids(counting.locations(places, "Recife"))) == [1, 3] and len(ids(counting.locations(places, ""))) == 3
    assert ids(counting.events(events, places)) == [1, 3, 2]
    assert ids(counting.events(events, places, EventFilter(start_date="2023-06-15", end_date="2023-07-01"))) == [3, 2]
    found = counting.events(events, places, EventFilter(city="Recife"))
    assert sorted(ids(found)) == [1, 2] and found.columns == events.columns
    assert ids(counting.events_of_location(places, events, 1)) == [1, 2] and ids(counting.events_of_location(places, events, 3)) == []
    with pytest.raises(NotFound, match="Not Found"):
        counting.events_of_location(places, events, 77)
    with pytest.raises(InvalidParameter):
        counting.get(places, "x")
    assert ids(counting.movements_of_session(sessions, movements, 1)) == [1, 2]
    assert {r["id"]: r["n_children"] for r in counting.with_children(places, events, "location_id").collect()} == {1: 2, 2: 1, 3: 0}


def test_analyses(counts):
    places, events, sessions, movements = counts
    assert {r["name"]: r["total_cyclists"] for r in counting.totals_per_location(places, events).collect()} == {"A": 6461, "B": 10}
    assert [(r["session_label"], r["max_cyclists"]) for r in counting.peak_hours(sessions).collect()] == [("07-08", 450), ("06-07", 351)]
    assert ids(counting.events_in_city_and_year(events, places, "Recife", 2023).orderBy("id")) == [1, 2]
    assert [(r["id"], r["women"]) for r in counting.characteristic(sessions, "women").orderBy("id").collect()] == [(1, 10), (2, None), (3, None)]
    assert ids(counting.sessions_above(sessions, "helmet", 20)) == [1] and ids(counting.metropolitan(places)) == [1]
    near = {r["id"]: r["distance_m"] for r in counting.within_radius(places, -8.05, -34.9, 10_000).collect()}
    assert near.keys() == {1, 2} and near[1] == 0 and 6000 < near[2] < 6500
    assert sorted(ids(counting.within_radius(places, 89.5, 0.0, 20_100_000))) == [1, 2, 3]
    m = [(r["from_direction"], r["to_direction"], r["total"]) for r in counting.movement_matrix(movements).collect()]
    assert m == [("east", "west", 9), ("north", "south", 9), ("south", "north", 7)]
    assert [r["total"] for r in counting.movement_matrix(movements, sessions, events, 1).collect()] == [9, 9, 7]
    assert counting.movement_matrix(movements, sessions, events, 2).count() == 0
    assert one(counting.volume(movements, "north", "south"))["total"] == 9 and one(counting.volume(movements, "west", "east"))["total"] == 0
    assert one(counting.busiest_entry(movements))["to_direction"] == "south" and one(counting.commonest_movement(movements))["from_direction"] == "east"


def test_nested_documents_and_cascade(counts):
    places, events, sessions, movements = counts
    nested = {r["id"]: r["sessions"] for r in counting.nested_events(events, sessions, movements).collect()}
    assert [s["id"] for s in nested[1]] == [1, 2] and [m["count"] for m in nested[1][0]["movements"]] == [5, 7] and nested[3] == []
    left = counting.delete_location(places, events, sessions, movements, 1)
    assert [t.count() for t in left] == [2, 1, 0, 0]


def test_constraints(counts):
    places, events, sessions, movements = counts
    broken = lambda df, rules: {r["rule"]: r["n"] for r in constraints.violations(df, rules).collect() if r["n"]}
    assert not broken(places, constraints.location_rules()) and not broken(sessions, constraints.session_rules())
    odd = movements.withColumn("to_direction", F.lit("north")).withColumn("count", -F.col("count"))
    assert broken(odd, constraints.movement_rules()) == {"from is not to": 2, "count not negative": 4}
    assert constraints.orphans(events, "location_id", places.filter("id = 1")).count() == 1
    assert constraints.repeated_keys(sessions, "event_id").count() == 1
    assert sorted(ids(constraints.uneven_totals(events, sessions))) == [1, 2, 3]


def test_profiles_and_health(spark):
    table = spark.createDataFrame([(42, '{"name":"Rider"}', '{"id":7}'), (43, "{}", '{"id":"7"}'), (44, "{}", "{}")], "id int, data string, metadata string")
    # Containment tells a number from its text.
    assert ids(profiles.containing(table, id=7)) == [42] and ids(profiles.containing(table, id="7")) == [43] and ids(profiles.containing(table, id=8)) == []
    assert profiles.profiles(table).count() == 3 and one(profiles.profile(table, 42))["data"] == '{"name":"Rider"}'
    with pytest.raises(NotFound):
        profiles.profile(table, 1)
    assert profiles.health(spark)["status"] == "ok" and profiles.health(None)["status"] == "error"


def test_predicates_leave_no_trace(spark):
    df = spark.range(5)
    assert predicates.keep(df, None, None) is df
    assert predicates.where(df, [("id", "between", (1, 3)), ("id", "not_in", [2])]).count() == 2
    assert predicates.missing(df, spark.range(3).withColumnRenamed("id", "k"), "id", "k").count() == 2


@pytest.mark.parametrize(
    ("style", "want"), [("kebab", "my-new-app2"), ("snake", "my_new_app2"), ("camel", "myNewApp2"), ("pascal", "MyNewApp2")]
)
def test_names(spark, style, want):
    assert one(spark.sql("select 'My new_App2' t").select(S.text_case(F.col("t"), style).alias("x")))["x"] == want


def test_text_helpers(spark):
    row = spark.sql("select 'my-app' good, 'My--app' bad, 'hi {{name}}!' t")
    got = one(row.select(S.valid_name(F.col("good")).alias("g"), S.valid_name(F.col("bad")).alias("b"), S.fill_template(F.col("t"), name=F.col("good")).alias("t")))
    assert got == {"g": True, "b": False, "t": "hi my-app!"}
