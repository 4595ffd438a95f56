"""Landings merged into a versioned star, against the star made from what should be left."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flightops import schemas
from flightops.operators.dims import aircraft_dimension
from flightops.operators.rollups import airport_delays_daily
from flightops.session import new_scratch_path
from flightops.sources import landing, versions
from flightops.sources.store import open_star, publish_from_landing, publish_star
from helpers import airports as make_airports


def doc(number, day=20, reg=None, model=None, origin="DEL", delay=0):
    scheduled = None if day is None else {"utc": f"2025-11-{day:02d} 06:00Z"}
    revised = None if day is None else {"utc": f"2025-11-{day:02d} 06:{delay:02d}Z"}
    return {"number": number, "status": "Arrived", "aircraft": {"reg": reg, "model": model}, "airline": {"name": f"air {model}"},
            "departure": {"airport": {"iata": origin, "icao": origin}, "scheduledTime": scheduled, "revisedTime": revised},
            "arrival": {"airport": {"iata": "BOM", "icao": "VABB"}}}


def answer(airport, window, flights, poll=None, idx=0):
    return {"poll": poll, "airport": airport, "window_idx": idx, "window_from": window, "departures": flights}


def envelopes(spark, rows):
    lines = [json.dumps(r) for r in rows]
    return spark.read.schema(landing.LANDED_ENVELOPE).json(spark.createDataFrame(
        [(x,) for x in lines], "value string").rdd.map(lambda r: r.value)) if lines else spark.createDataFrame([], landing.LANDED_ENVELOPE)


def flights_of(spark, rows):
    flights = landing.flights_from_envelopes(envelopes(spark, rows))
    return flights.withColumn(schemas.FLIGHT_MONTH, F.date_format(schemas.FLIGHT_DATE, "yyyy-MM"))


def merge(spark, path, rows, airports=None):
    env = envelopes(spark, rows)
    version = versions.prepare_merge(spark, path, flights_of(spark, rows), airports, landing.answered_requests(env))
    return versions.commit(spark, path, version)


def start(spark, rows, by=schemas.FLIGHT_MONTH):
    path = new_scratch_path(spark, "versions-test")
    versions.commit(spark, path, versions.prepare_replace(spark, path, make_airports(spark), flights_of(spark, rows), by))
    return path


def numbers(spark, path, version=None):
    return sorted(r.flight_id for r in open_star(spark, path, version).flights.collect())


def check_derived(spark, path, rows):
    """Flights, dimension and rollup equal those made from `rows` at once."""
    star, whole = open_star(spark, path), flights_of(spark, rows)

    def bag(df, cols):
        return sorted(map(str, df.select(*cols).collect()))
    assert bag(star.flights, schemas.FLIGHT_COLUMNS) == bag(whole, schemas.FLIGHT_COLUMNS)
    assert bag(star.aircraft, schemas.AIRCRAFT_COLUMNS) == bag(aircraft_dimension(whole), schemas.AIRCRAFT_COLUMNS)
    cols = [f.name for f in schemas.AIRPORT_DELAYS.fields]
    now = versions.read_version(spark, path)
    assert bag(versions.read_table(spark, path, now, "delays"), cols) == bag(airport_delays_daily(whole), cols)


def test_answers_without_a_window_replace_nothing(spark):
    first = [answer("DEL", None, [doc(f"A {k}", 20 + k % 3) for k in range(10)]), answer(None, "2025-11-20T00:00", [doc("N 1")])]
    second = [answer("DEL", None, [doc("B 1")]), answer(None, "2025-11-20T00:00", [doc("N 2")])]
    path = start(spark, first)
    merge(spark, path, second)
    assert numbers(spark, path) == sorted([f"A {k}" for k in range(10)] + ["B 1", "N 1", "N 2"])
    check_derived(spark, path, first + second)


def test_airports_of_a_partial_landing_join_those_on_disk(spark):
    path = start(spark, [answer("DEL", "2025-11-20T00:00", [doc("A 1")])])
    one = make_airports(spark).where("iata_code = 'DEL'").withColumn("name", F.lit("New name"))
    merge(spark, path, [answer("DEL", "2025-11-21T00:00", [doc("A 2", 21)])], one)
    got = {r.iata_code: r.name for r in open_star(spark, path).airports.collect()}
    assert got == {"DEL": "New name", "BOM": "Mumbai", "DXB": "Dubai", "LHR": "Heathrow", "MAA": "Chennai"}


def test_a_replaced_answer_takes_its_rows_its_day_and_its_first_sight(spark):
    w1, w2, w3 = "2025-11-20T00:00", "2025-11-20T12:00", "2025-12-01T00:00"
    kept = [answer("DEL", w2, [doc("B 1", 20, "R2", "ATR 42"), doc("B 2", 20, "R1", "Boeing 7")], idx=1),
            answer("BOM", w1, [doc("C 1", None, "R9", "X")])]
    # an overnight arrival and an untimed flight of w1 lie in other partitions than w1's day
    first = [answer("DEL", w1, [doc("A 1", 20, "R1", "ATR 72"), doc("A 2", 1, "R3", "Airbus"), doc("A 3", None, "R4", "Y")]), *kept]
    path = start(spark, first)
    assert open_star(spark, path).aircraft.where("aircraft_reg = 'R1'").first().aircraft_model == "ATR 72"
    again = [answer("DEL", w1, [doc("A 4", 2, "R5", "Z")]), answer("DEL", w3, [])]
    merge(spark, path, again)
    check_derived(spark, path, [*kept, *again])
    # answered again, without a flight
    merge(spark, path, [answer("DEL", w1, [])])
    check_derived(spark, path, kept)


def test_a_writer_that_stops_leaves_the_last_version(spark, monkeypatch):
    rows = [answer("DEL", "2025-11-20T00:00", [doc("A 1")])]
    path = start(spark, rows)
    more = [answer("DEL", "2025-11-20T00:00", [doc("B 1")])]
    real, calls = versions._write, []
    for stop in range(1, 6):
        calls.clear()

        def failing(*args, stop=stop, **kw):
            calls.append(1)
            if len(calls) == stop:
                raise OSError("disk")
            return real(*args, **kw)
        monkeypatch.setattr(versions, "_write", failing)
        with pytest.raises(OSError):
            merge(spark, path, more, make_airports(spark))
        monkeypatch.setattr(versions, "_write", real)
        assert numbers(spark, path) == ["A 1"] and len(open_star(spark, path).rows) == 2
    # a version file cut off by its writer's death isn't a version
    fs, where = versions._fs(spark, f"{path}/versions/v000000002.json")
    out = fs.create(where, False)
    out.write(bytearray(b'{"number": 2, "live"'))
    out.close()
    assert numbers(spark, path) == ["A 1"]
    assert merge(spark, path, more).number == 3 and numbers(spark, path) == ["B 1"]
    assert numbers(spark, path, 1) == ["A 1"]
    assert any(x.startswith("flights/") for x in versions.drop_unreferenced(spark, path, keep=1))
    check_derived(spark, path, more)
    assert versions.read_version(spark, path, 1) is None


def test_two_writers_cannot_both_publish(spark):
    path = start(spark, [answer("DEL", "2025-11-20T00:00", [doc("A 1")])])
    one, two = (versions.prepare_merge(spark, path, flights_of(spark, [answer("DEL", f"2025-11-2{k}T00:00", [doc(f"B {k}")])]))
                for k in (1, 2))
    versions.commit(spark, path, one)
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark, path, two)
    assert numbers(spark, path) == ["A 1", "B 1"]


def test_a_merge_reads_only_the_partitions_it_changes(spark, monkeypatch):
    rows = [answer("DEL", f"2025-{m:02d}-01T00:00", [{**doc(f"A {m}"), "departure": {
        "airport": {"iata": "DEL", "icao": "DEL"}, "scheduledTime": {"utc": f"2025-{m:02d}-01 06:00Z"}}}]) for m in range(1, 10)]
    path = start(spark, rows)
    read, real = [], versions.read_table

    def watched(spark, root, version, table, partitions=None):
        df = real(spark, root, version, table, partitions)
        read.append((table, {f.split("/")[-2] for f in df.inputFiles()}))
        return df
    monkeypatch.setattr(versions, "read_table", watched)
    before = versions.read_version(spark, path)
    merge(spark, path, [rows[4]])
    for table in ("flights", "requests"):
        seen = set().union(*(parts for name, parts in read if name == table))
        assert seen == {"flight_month=2025-05" if table == "flights" else "window_month=2025-05"}
    assert not any(name == "sightings" and len(parts) > 1 for name, parts in read)
    after = versions.read_version(spark, path)
    assert len(set(before.live["flights"]) & set(after.live["flights"])) == 8
    # a landing of new windows reads no flight at all, and adds a folder
    read.clear()
    merge(spark, path, [answer("DEL", "2025-05-02T00:00", [doc("B 1", 2)])])
    last = versions.read_version(spark, path)
    assert not any(parts for name, parts in read if name == "flights" and parts and not parts <= {"flight_month=2025-11"})
    assert len(last.live["flights"]) == len(after.live["flights"]) + 1


def test_folders_of_a_partition_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(versions, "MAX_FOLDERS", 2)
    rows = [answer("DEL", f"2025-11-{d}T00:00", [doc(f"A {d}", d)]) for d in range(10, 14)]
    path = start(spark, rows[:1])
    for r in rows[1:]:
        merge(spark, path, [r])
        assert len(versions.read_version(spark, path).live["flights"]) <= 2
    check_derived(spark, path, rows)


def test_random_landings_equal_one_publish(spark):
    rng = random.Random(8)
    held, path = {}, None
    for step in range(5):
        rows = []
        for k in range(rng.randrange(1, 7)):
            window = rng.choice([None, "2025-11-28T00:00", "2025-11-28T12:00", "2025-12-01T00:00"])
            airport = rng.choice(["DEL", "BOM"])
            flights = [doc(f"{step}.{k}.{j}", rng.choice([None, 1, 28, 29]), rng.choice([None, "", "R1", "R2", "R3"]),
                           rng.choice(["ATR 1", "Airbus 2", None]), delay=rng.randrange(50)) for j in range(rng.randrange(4))]
            rows.append(answer(airport, window, flights, poll=f"p{step}", idx=rng.randrange(6)))
        for key in {(r["airport"], r["window_from"]) for r in rows if r["window_from"]}:
            held.pop(key, None)
        for r in rows:
            key = (r["airport"], r["window_from"]) if r["window_from"] else (step, len(held))
            held.setdefault(key, []).append(r)
        if path is None:
            path = start(spark, rows)
        else:
            merge(spark, path, rows)
        check_derived(spark, path, [r for rs in held.values() for r in rs])


def test_production_path_takes_over_a_plain_star(spark):
    root = new_scratch_path(spark, "takeover")
    envelopes(spark, [answer("DEL", "2025-11-20T00:00", [doc("A 1", 20, "R1", "ATR 72")]),
                      answer("DEL", None, [doc("A 2", None)])]).drop(landing.CORRUPT).write.json(f"{root}/one")
    envelopes(spark, [answer("DEL", "2025-11-20T00:00", [doc("B 1", 21)]), answer("DEL", None, [doc("B 2", 21)])]).drop(
        landing.CORRUPT).write.json(f"{root}/two")
    docs = {"one": ["DEL", "BOM"], "two": ["BOM"]}
    for name, codes in docs.items():
        spark.createDataFrame([(c, c, f"{c} {name}") for c in codes], "icao string, iata string, shortName string").write.json(f"{root}/docs-{name}")
    publish_from_landing(spark, f"{root}/docs-one", f"{root}/one", f"{root}/star")
    star = publish_from_landing(spark, f"{root}/docs-two", f"{root}/two", f"{root}/star", mode="merge")
    assert sorted(r.flight_id for r in star.flights.collect()) == ["A 2", "B 1", "B 2"] and star.aircraft.count() == 0
    assert {r.iata_code: r.name for r in star.airports.collect()} == {"DEL": "DEL one", "BOM": "BOM two"}
    # a replace at a versioned star is a version too
    flights = landing.flights_from_envelopes(landing.read_envelopes(spark, f"{root}/one"))
    star = publish_star(spark, make_airports(spark), flights, f"{root}/star")
    assert star.flights.count() == 2 and star.airports.count() == 5
    assert versions.read_version(spark, f"{root}/star").number == 3
