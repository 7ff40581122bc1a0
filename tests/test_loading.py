"""Ingest from small raw files: conversion, rejects, deduplication, keys and repeated loads."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from roadlens import ingest_queries
from roadlens.catalogue import SQL
from roadlens.functions import scalars as S
from roadlens.plans import schemas
from roadlens.sources import counts, deaths, files, loading, profiles, tables
from roadlens.streaming import incremental

HEADER = "CONTADOR,DTOBITO,CAUSABAS,IDADE,CODMUNOCOR,LINHAA,dtatestado,PESO"
LINES = [
    '"1","01032019","V123","412","2611606","a, b","02032019","70"',
    '"2","NA","V1","","1","","",""',
    '"3","01032019","","1","1","","",""',
    '"4","31022020","V2","1","1","","",""',
    '"5","1012020","V2","1","1","","",""',
    '"6","01132020","V2","1","1","","",""',
    '"12abc"," 05042019 ","V9","abc","NA","x","",""',
    '"8","06042019","V4","7"',
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "mortes_transito_2019.csv").write_text("\n".join([HEADER, *LINES]) + "\n", encoding="utf-8")
    (tmp_path / "mortes_transito_2021.csv").write_text(HEADER + '\n"9","01012021","V10","30","2609600","","",""\n', encoding="utf-8")
    return tmp_path


def test_death_files(spark, folder):
    raw = files.read_years(spark, str(folder))
    rows = deaths.converted(raw, extras=True)
    good = {r["contador"]: r for r in deaths.accepted(rows).collect()}
    assert good.keys() == {1, 12, 8, 9}
    assert good[1]["dtobito"] == dt.date(2019, 3, 1) and good[1]["linhaa"] == "a, b" and good[1]["dtatestado"] == dt.date(2019, 3, 2) and good[1]["peso"] == 70
    assert good[12]["idade"] is None and good[12]["codmunocor"] is None and good[12]["dtobito"] == dt.date(2019, 4, 5)
    assert good[8]["linhaa"] is None and good[8]["idade"] == 7
    assert good[9]["data_year"] == 2021 and good[1]["data_year"] == 2019
    assert {r["contador"]: r["reject"] for r in deaths.rejected(rows).collect()} == {2: "dtobito missing", 3: "causabas missing", 4: "dtobito is no date", 5: "dtobito is no date", 6: "dtobito is no date"}


def test_uneven_rows_can_be_dropped(spark, folder):
    raw = files.read_years(spark, str(folder), drop_uneven=True)
    assert "8" not in {r["contador"] for r in raw.collect()} and raw.count() == 8


def test_years_load_once(spark, folder, tmp_path):
    rows = deaths.accepted(deaths.converted(files.read_years(spark, str(folder))))
    keyed = deaths.with_keys(rows, deaths.batch_mark(dt.datetime(2024, 1, 2)), start=10)
    assert keyed.columns == schemas.TRAFFIC_DEATHS.names
    assert sorted(r["id"] for r in keyed.collect()) == [11, 12, 13, 14] and keyed.first()["import_batch"] == "seed-2024-01-02T00:00:00Z"
    deaths.write(keyed, str(tmp_path / "out"))
    loaded = spark.read.schema(schemas.TRAFFIC_DEATHS).parquet(str(tmp_path / "out"))
    assert loaded.count() == 4 and loaded.filter("data_year = 2021").count() == 1
    more = rows.unionByName(rows.filter("data_year = 2021").withColumn("data_year", F.lit(2022)))
    assert [r["data_year"] for r in deaths.new_years(more, loaded).collect()] == [2022]


def test_stream_loads_what_is_new(spark, folder, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    names = HEADER.split(",")
    (source / "mortes_transito_2019.csv").write_bytes((folder / "mortes_transito_2019.csv").read_bytes())
    go = lambda: incremental.load_available(spark, str(source), names, str(tmp_path), str(tmp_path / "state")).awaitTermination()
    go()
    (source / "mortes_transito_2021.csv").write_bytes((folder / "mortes_transito_2021.csv").read_bytes())
    (source / "again_2019.csv").write_bytes((folder / "mortes_transito_2019.csv").read_bytes())
    go()
    got = spark.read.schema(schemas.TRAFFIC_DEATHS).parquet(str(tmp_path / "traffic_deaths"))
    assert sorted((r["data_year"], r["id"]) for r in got.collect()) == [(2019, 1), (2019, 2), (2019, 3), (2021, 4)]


@pytest.mark.parametrize(("text", "want"), [("12abc", 12), ("abc", None), (" -7 ", -7), ("", None), (None, None), ("99999999999", None), ("+3.9", 3)])
def test_leading_int(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.leading_int(F.col("t")).alias("x")).first()["x"] == want


def document(name, date, x=1.0, y=2.0, sessions=(), coordinates=True):
    body = [
        {"session": f"{6 + i:02d}-{7 + i:02d}", "start_time": f"2013-03-25T{6 + i:02d}:00:00", "end_time": f"2013-03-25T{7 + i:02d}:00:00", "total_cyclists": n,
         "quantitative": {k: (n if k == "north_south" else 0) for k in schemas.MOVEMENT_KEYS}, "characteristics": dict.fromkeys(schemas.CHARACTERISTICS, i)}
        for i, n in enumerate(sessions)
    ]
    meta = {"name": name, "date": date, "city": {"id": 1, "name": "Recife", "state": "PE", "full_state": "Pernambuco", "rmr": True}, "directions": {"north": "N"}}
    return {"id": 1, **({"coordinates": {"x": x, "y": y}} if coordinates else {}), "metadata": meta, "data": {"sessions": body}}


@pytest.fixture
def documents(spark, tmp_path):
    docs = [
        document("A", "2013-3-25", sessions=[5, 9]),
        document("A", "2013-03-25", x=9.0, sessions=[1]),
        document("A", "2014-01-02T03:00:00", sessions=[0, 4]),
        document("B", "2015-01-01", sessions=[]),
        document("C", "2015-01-01", x=0.0, sessions=[3]),
        document("D", "2015-01-01", coordinates=False, sessions=[3]),
    ]
    (tmp_path / "counts.json").write_text(json.dumps(docs, indent=1))
    return files.read_documents(spark, str(tmp_path / "counts.json"), schemas.COUNT_DOCUMENT)


def test_counts(documents):
    got = counts.load(documents)
    places = {r["name"]: r for r in got.locations.collect()}
    assert places.keys() == {"A", "B"} and float(places["A"]["longitude"]) == 1.0 and json.loads(places["A"]["metadata"])["is_rmr"] is True
    events = got.events.orderBy("id").collect()
    assert [(e["counting_date"], e["total_cyclists"], e["max_hour_cyclists"], e["start_time"], e["end_time"]) for e in events] == [
        (dt.date(2013, 3, 25), 14, 9, "06:00:00", "08:00:00"), (dt.date(2014, 1, 2), 4, 4, "06:00:00", "08:00:00"),
    ]
    assert got.sessions.count() == 4
    assert [(m["session_id"], m["from_direction"], m["to_direction"], m["count"]) for m in got.movements.orderBy("id").collect()] == [(1, "north", "south", 5), (2, "north", "south", 9), (4, "north", "south", 4)]
    again = counts.load(documents, got.locations, got.events)
    assert [t.count() for t in again] == [0, 0, 0, 0]


def test_entries_keep_zeros(spark):
    rows = spark.createDataFrame([(1, '{"north_south": 0, "east_west": 3}')], "id int, m string")
    assert {(r["from_direction"], r["count"]) for r in counts.unpivot_entries(rows, "m").collect()} == {("north", 0), ("east", 3)}


def test_profiles(spark, tmp_path):
    docs = [{"id": 7, "data": {"a": 1}, "metadata": {"id": 99, "x": [1, "two", {"y": None}], "t": 'q"uote'}}, {"data": {}}, {"id": 0, "data": {}}, {"id": 7, "data": {"b": 2}}, {"id": 8, "data": {"n": 1.5}, "created_at": "x"}]
    (tmp_path / "p.json").write_text(json.dumps(docs))
    raw = files.read_documents(spark, str(tmp_path / "p.json"))
    got = {r["id"]: r for r in profiles.load(raw).collect()}
    assert got.keys() == {1, 2} and json.loads(got[1]["data"]) == {"a": 1}
    assert json.loads(got[1]["metadata"]) == {"id": 7, "x": [1, "two", {"y": None}], "t": 'q"uote'} and json.loads(got[2]["metadata"]) == {"id": 8}
    assert profiles.skipped(raw).count() == 2
    existing = spark.createDataFrame([(5, "{}", '{"id": 7}')], "id int, data string, metadata string")
    assert [r["id"] for r in profiles.load(raw, existing).collect()] == [6]
    merged = spark.createDataFrame([('{"date":"2019-03-25T10:00","hour":"2000-01-01T07:30"}',), ('{"date":"2019-03-25","hour":"08:00"}',)], "m string")
    assert [r["i"] for r in merged.select(profiles.instant(F.col("m")).alias("i")).collect()] == ["2019-03-25T07:30", "2019-03-25T08:00"]


def test_manifest_and_checksums(spark, folder, tmp_path):
    path = f"{folder}/mortes_transito_2021.csv"
    mark = files.checksums(spark, [path]).first()["checksum"]
    entry = lambda c: {"version": "1.0", "datasets": {"deaths": {"storage": "s3", "s3": {"bucket": "b", "files": [{"name": "mortes_transito_2021.csv", "key": "k/m.csv", "size": 9, "checksum": c}]}}}}
    (tmp_path / "manifest.json").write_text(json.dumps(entry(mark)))
    listing = files.manifest(spark, str(tmp_path / "manifest.json"))
    assert files.resolve(listing, "deaths", remote=True)[0].path == "s3a://b/k/m.csv"
    local = files.resolve(listing, "deaths", remote=False, folder=str(folder))
    assert files.verify(spark, local).count() == 1
    (tmp_path / "bad.json").write_text(json.dumps(entry("sha256:00")))
    with pytest.raises(files.ChecksumMismatch):
        files.verify(spark, files.resolve(files.manifest(spark, str(tmp_path / "bad.json")), "deaths", remote=False, folder=str(folder)))
    with pytest.warns(UserWarning, match="mortes_transito_2021"):
        assert files.verify(spark, files.resolve(files.manifest(spark, str(tmp_path / "bad.json")), "deaths", remote=False, folder=str(folder)), warn_only=True).count() == 1
    assert files.object_store("e", "r", "k", "s")["spark.hadoop.fs.s3a.path.style.access"] == "true"


def test_cache(spark):
    cache, made = files.TableCache(ttl_seconds=100), []
    load = lambda: made.append(1) or spark.range(3)
    assert cache.get("a", load) is cache.get("a", load) and len(made) == 1 and cache.stats().keys() == {"a"}
    cache.get("a", load).count()
    assert 0 < cache.sizes()["a"] < 10_000
    cache.ttl_seconds = -1
    cache.get("a", load)
    assert len(made) == 2
    cache.clear()
    assert not cache.stats()


def test_rows_go_to_a_database_and_back(spark):
    url = "jdbc:derby:memory:roadlens;create=true"
    rows = spark.range(2500).selectExpr("cast(id as int) id", "concat('place ', id) name", "cast(id % 7 as int) kind")
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    tables.put(rows.filter("id < 1000"), url, "places", **driver)
    tables.put(rows.filter("id >= 1000"), url, "places", batch=100, parts=3, **driver)
    back = tables.jdbc(spark, url, "places", bounds=(0, 2500), **driver)
    assert back.rdd.getNumPartitions() == 8
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize(("wanted", "held"), [
    ({"a": 5}, True), ({"a": "5"}, False), ({"t": "5"}, True), ({"t": 5}, False), ({"o": {"p": {"q": [1, 2]}}}, True), ({"o": {"p": {"q": [2]}}}, True),
    ({"o": {"p": {"q": [3]}}}, False), ({"o": {"p": 1}}, False), ({"n": None}, True), ({"missing": None}, False), ({"b": True}, True), ({"b": "true"}, False), ({"l": [{"x": 1}]}, True), ({"f": 1.5}, True),
])
def test_containment(spark, wanted, held):
    doc = '{"a": 5, "t": "5", "o": {"p": {"q": [1, 2], "r": 0}}, "n": null, "b": true, "l": [{"x": 1, "y": 2}, 3], "f": 1.50}'
    rows = spark.createDataFrame([(doc,), ("no json",), (None,), ("[1]",)], "d string")
    assert [r["h"] for r in rows.select(S.json_contains(F.col("d"), **wanted).alias("h")).collect()] == [held, False, False, False]


def test_orchestration(spark):
    def bad():
        raise ValueError("no data")

    tasks = {"counts": lambda: {"created": 3}, "profiles": bad, "deaths": lambda: {}}
    report = loading.run(spark, tasks)
    got = {r["task"]: r for r in report.collect()}
    assert got["counts"]["details"] == {"created": 3} and got["profiles"]["error"] == "ValueError: no data" and got["deaths"]["success"]
    assert loading.failed(report) and not loading.failed(loading.run(spark, tasks, skip=["profiles"]))
    assert [r["task"] for r in loading.run(spark, tasks, only=["deaths"]).collect()] == ["deaths"]
    assert loading.lines(report).first()["line"].startswith("ok | counts               | ")


def test_loads_run_twice_and_add_once(spark, folder, tmp_path, documents):
    root = str(tmp_path / "store")
    (tmp_path / "p.json").write_text(json.dumps([{"id": 7, "data": {}}, {"data": {}}]))
    tasks = {
        "counts": lambda: loading.load_counts(spark, str(tmp_path / "counts.json"), root),
        "profiles": lambda: loading.load_profiles(spark, str(tmp_path / "p.json"), root),
        "deaths": lambda: loading.load_deaths(spark, str(folder), root),
    }
    first, second = ({r["task"]: (r["success"], r["details"], r["error"]) for r in loading.run(spark, tasks).collect()} for _ in range(2))
    assert first["counts"] == (True, {"counting_locations": 2, "counting_events": 2, "counting_sessions": 4, "session_movements": 3, "skipped": 2}, None)
    assert first["profiles"] == (True, {"created": 1, "skipped": 1}, None) and first["deaths"] == (True, {"created": 4, "skipped": 0, "errors": 5 - 0}, None)
    assert second["deaths"][1]["created"] == 0 and second["profiles"][1]["created"] == 0 and second["counts"][1]["counting_events"] == 0
    assert tables.read(spark, root, "traffic_deaths").count() == 4 and tables.read(spark, root, "counting_sessions").count() == 4


def test_a_second_document_adds_all_of_its_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    both = [document("A", "2013-3-25", sessions=[5, 9]), document("B", "2014-05-06", sessions=[7, 0, 3]), document("A", "2015-01-01", sessions=[2])]
    counters = []
    for n in (1, 3):
        (tmp_path / "c.json").write_text(json.dumps(both[:n]))
        counters.append(loading.load_counts(spark, str(tmp_path / "c.json"), root))
    assert counters == [
        {"counting_locations": 1, "counting_events": 1, "counting_sessions": 2, "session_movements": 2, "skipped": 0},
        {"counting_locations": 1, "counting_events": 2, "counting_sessions": 4, "session_movements": 3, "skipped": 0},
    ]
    stored = {name: [r.asDict() for r in tables.read(spark, root, name).orderBy("id").collect()] for name in loading.COUNT_TABLES}
    assert all([r["id"] for r in rows] == list(range(1, len(rows) + 1)) for rows in stored.values())
    assert [(r["location_id"], r["total_cyclists"]) for r in stored["counting_events"]] == [(1, 14), (2, 10), (1, 2)]
    assert [(r["event_id"], r["total_cyclists"]) for r in stored["counting_sessions"]] == [(1, 5), (1, 9), (2, 7), (2, 0), (2, 3), (3, 2)]
    assert [(r["session_id"], r["count"]) for r in stored["session_movements"]] == [(1, 5), (2, 9), (3, 7), (5, 3), (6, 2)]


def test_a_load_that_died_is_completed_or_dropped(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    tables.stage(spark, root, {"counting_locations": rows})
    tables.append(rows.filter("id = 1"), root, "counting_locations")  # as far as the run came
    tables.append(rows.withColumn("id", F.col("id") + 10), f"{root}/{tables.STAGED}/unfinished", "counting_locations")
    for _ in range(2):
        tables.settle(spark, root)
        assert sorted(r["id"] for r in tables.read(spark, root, "counting_locations").collect()) == [1, 2]


def test_numbers_follow_the_order_over_blocks(spark):
    rows = spark.range(0, 50_000, 7, 5).select((F.col("id") * 3).alias("a"), (F.col("id") % 5).alias("b"))
    got = [(r["a"], r["id"]) for r in counts.numbered(rows, ["a", "b"], 100).orderBy("a").collect()]
    assert [n for _, n in got] == list(range(101, 101 + len(got)))
    assert counts.numbered(rows.limit(0), ["a"]).count() == 0


def test_documents_as_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(document(n, "2013-3-25", sessions=[1])) for n in "AB") + "\n\n")
    got = files.read_documents(spark, str(tmp_path / "c.jsonl"), schemas.COUNT_DOCUMENT, lines=True)
    assert [r["metadata"]["name"] for r in got.orderBy("position").collect()] == ["A", "B"]
    assert files.read_documents(spark, str(tmp_path / "c.jsonl"), lines=True).columns == ["position", "document"]


def test_documents_follow_their_files_names(spark, tmp_path):
    folder = tmp_path / "some files"
    folder.mkdir()
    names = iter(f"{i:03d}" for i in range(100))
    for place, n in enumerate((1, 3, 40, 2)):  # Spark reads the longest first
        docs = [document(next(names), "2013-3-25", sessions=[1]) for _ in range(n)]
        (folder / f"{place}.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\n")
        (folder / f"{place}.json").write_text(json.dumps(docs))
    for kind in ("jsonl", "json"):
        got = files.read_documents(spark, f"{folder}/*.{kind}", schemas.COUNT_DOCUMENT, lines=kind == "jsonl").orderBy("position").collect()
        assert [r["metadata"]["name"] for r in got] == [f"{i:03d}" for i in range(46)] and len({r["position"] for r in got}) == 46
        texts = files.read_documents(spark, f"{folder}/*.{kind}", lines=kind == "jsonl").orderBy("position").collect()
        assert [json.loads(r["document"])["metadata"]["name"] for r in texts] == [f"{i:03d}" for i in range(46)]


def test_documents_are_written_by_several_tasks(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        folder = ingest_queries.count_documents(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset(setting)
    rows = spark.read.text(folder).groupBy(F.input_file_name()).count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 0.5 * sum(r["count"] for r in rows)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").orderBy("o_orderkey").collect()
    got = files.read_documents(spark, folder, schemas.COUNT_DOCUMENT, lines=True).orderBy("position").collect()
    assert [(r["metadata"]["name"], r["metadata"]["date"]) for r in got] == [(f"place {o['o_custkey'] % 10}", f"{(d := o['o_orderdate']).year}-{d.month}-{d.day}") for o in orders]


@pytest.mark.parametrize("bound", [counts.BROADCAST_EVENTS, 1])
def test_events_are_chosen_without_their_sessions(spark, documents, monkeypatch, bound):
    seen, first_wins = [], counts.first_wins
    monkeypatch.setattr(counts, "first_wins", lambda rows, *a: seen.append(set(rows.columns)) or first_wins(rows, *a))
    monkeypatch.setattr(counts, "BROADCAST_EVENTS", bound)
    got = counts.load(documents)
    assert seen and not any("sessions" in columns for columns in seen)
    assert [(e["id"], e["location_id"], e["counting_date"], e["total_cyclists"]) for e in got.events.orderBy("id").collect()] == [(1, 1, dt.date(2013, 3, 25), 14), (2, 1, dt.date(2014, 1, 2), 4)]
    assert [(r["id"], r["event_id"], r["total_cyclists"]) for r in got.sessions.orderBy("id").collect()] == [(1, 1, 5), (2, 1, 9), (3, 2, 0), (4, 2, 4)]


def test_lines_are_dealt_by_order_before_they_are_gathered(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = ingest_queries.order_numbers(lines)._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("Exchange")
    assert "collect_list" in plan[:dealt] and "collect_list" not in plan[dealt:]
    want = {}
    for r in lines.collect():
        pair = schemas.DIRECTIONS[r["l_suppkey"] % 4] + "_" + schemas.DIRECTIONS[(r["l_suppkey"] % 4 + 1 + r["l_partkey"] % 3) % 4]
        want.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], int(r["l_quantity"]), len(schemas.MOVEMENT_KEYS) - schemas.MOVEMENT_KEYS.index(pair)))
    got = {r["l_orderkey"]: [tuple(n) for n in r["numbers"]] for r in ingest_queries.order_numbers(lines).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("lines", [True, False])
def test_documents_of_several_files_are_read_without_python(spark, tmp_path, lines):
    for name in ("a", 'b "quoted" é'):
        docs = [document(name, "2013-3-25", sessions=[1])]
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, docs)) if lines else json.dumps(docs))
    got = files.read_documents(spark, str(tmp_path), schemas.COUNT_DOCUMENT, lines=lines)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["metadata"]["name"] for r in got.orderBy("position").collect()] == ["a", 'b "quoted" é']


def test_both_loads_read_what_several_tasks_wrote(spark, monkeypatch):
    folders, written, setting = [], ingest_queries.count_documents, "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(ingest_queries, "count_documents", lambda *a: folders.append(written(*a)) or folders[-1])
    spark.conf.set(setting, "false")
    try:
        rows = ingest_queries.counts_load_twice(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset(setting)
    assert [len(set(spark.read.text(f).inputFiles())) for f in folders] == [4, 4]
    with duckdb.connect() as db:
        for t in ("orders", "lineitem"):
            db.sql(f"create view {t} as from '/root/testdata/sf0.001/{t}.parquet'")
        want = db.sql(SQL["counts_load_twice"]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_schemas():
    assert {n: len(t.fields) for n, t in schemas.TABLES.items()} == {"traffic_deaths": 51, "counting_locations": 9, "counting_events": 11, "counting_sessions": 9, "session_movements": 6, "cyclist_profiles": 5}
    assert "PARTITIONED BY (data_year)" in schemas.ddl("traffic_deaths") and len(schemas.MOVEMENT_KEYS) == 12
