"""Ingest and sinks: JSON envelopes, malformed lines, CSV, publish with partition replace."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from flightops.operators.dims import aircraft_dimension
from flightops.session import local_path, new_scratch_path
from flightops.sources import landing
from flightops.sources.store import publish_from_landing
from flightops.sources.sinks import export_csv, merge_table, publish_table
from helpers import T0, flights


def write_lines(spark, tag, lines):
    path = new_scratch_path(spark, tag)
    d = local_path(path)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "part-0.json"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return path


FLIGHT = {
    "number": "AI 101", "status": "CanceledUncertain",
    "aircraft": {"reg": "VT-X", "model": "Airbus A320"},
    "airline": {"iata": "AI", "name": "Air India", "icao": "AIC"},
    "departure": {"airport": {"iata": "DEL", "icao": "VIDP"},
                  "scheduledTime": {"utc": "2025-11-20 06:05Z"}, "revisedTime": {"utc": "2025-11-20 06:20Z"}},
    "arrival": {"airport": {"iata": "BOM", "icao": "VABB"},
                "scheduledTime": {"utc": "2025-11-20 08:00Z"}, "revisedTime": {"utc": "bad"}},
}


def test_rejects_are_counted_by_reason(spark):
    bad_time = dict(FLIGHT, departure={"airport": {"iata": "DEL", "icao": "VIDP"},
                                       "scheduledTime": {"utc": "20/11/2025 06:05"}})
    bad_time["arrival"] = {"airport": {"iata": "BOM", "icao": "VABB"}}
    good = json.loads(json.dumps(FLIGHT).replace('"bad"', '"2025-11-20 08:05Z"'))
    bare = {k: v for k, v in good.items() if k not in ("number", "aircraft", "airline")}
    window = {"window_idx": 0, "window_from": "2025-11-20T00:00", "window_to": "2025-11-20T12:00"}
    lines = [
        json.dumps({"airport": "DEL", **window, "departures": [good, bad_time, bare]}),
        json.dumps({"airport": "DEL", **window, "arrivals": [dict(good, isCargo="yes"), good]}),
        json.dumps({"airport": "DEL", **window, "window_idx": "first", "arrivals": []}),
        json.dumps({"airport": "BOM", **window}),
        json.dumps({"airport": "BOM", **window, "departures": [good]})[:-9],
    ]
    env = landing.read_envelopes(spark, write_lines(spark, "rejects", lines))
    got = {r.airport: r.asDict() for r in landing.landing_rejects(env).collect()}
    zero = dict.fromkeys(got["DEL"], 0)
    assert got["DEL"] == dict(zero, airport="DEL", lines=3, wrong_typed=2, no_window=1, flights=5,
                              bad_times=1, no_number=1, no_aircraft=1, no_airline=1)
    assert got["BOM"] == dict(zero, airport="BOM", lines=1, without_flights=1)
    assert got[None] == dict(zero, airport=None, lines=1, broken_lines=1)
    answers = {r.airport: (r.answers, r.malformed) for r in landing.landing_totals(env).collect()}
    assert answers == {"DEL": (3, 0), "BOM": (1, 0), None: (0, 1)}


def test_an_empty_answer_replaces_its_window(spark):
    window = {"airport": "DEL", "window_idx": 0, "window_from": "2025-11-20T00:00"}
    docs = write_lines(spark, "docs", [json.dumps({"icao": "VIDP", "iata": "DEL"})])
    path = new_scratch_path(spark, "empty-answer")
    first = write_lines(spark, "first", [json.dumps({**window, "departures": [FLIGHT]}), json.dumps(
        {**window, "window_from": "2025-11-20T12:00", "departures": [dict(FLIGHT, number="AI 2")]})])
    assert publish_from_landing(spark, docs, first, path).flights.count() == 2
    again = write_lines(spark, "again", [json.dumps({**window, "departures": []})])
    star = publish_from_landing(spark, docs, again, path, mode="merge")
    assert [r.flight_id for r in star.flights.collect()] == ["AI 2"]


def test_equal_places_give_one_aircraft_row(spark):
    env = [json.dumps({"airport": "DEL", "window_idx": 0, "window_from": "2025-11-20T00:00",
                       "departures": [dict(FLIGHT, aircraft={"reg": "R1", "model": m})]})
           for m in ("Boeing 737", "Airbus A320")]
    for k, lines in enumerate((env, env[::-1])):
        flights = landing.flights_from_envelopes(
            landing.read_envelopes(spark, write_lines(spark, f"places{k}", lines)))
        assert [r.aircraft_model for r in aircraft_dimension(flights).collect()] == ["Airbus A320"]


def test_envelopes_flatten_with_null_arrays_and_rejects(spark):
    no_number = dict(FLIGHT, number=None, isCargo=None)
    no_number.pop("number")
    lines = [
        json.dumps({"airport": "DEL", "window_idx": 0, "departures": [FLIGHT], "arrivals": None}),
        json.dumps({"airport": "DEL", "window_idx": 1, "arrivals": [no_number, {"status": "Arrived"}]}),
        json.dumps({"airport": "BOM", "window_idx": 0}),
        "{not json",
    ]
    path = write_lines(spark, "landing-test", lines)
    env = landing.read_envelopes(spark, path)
    fl = landing.flights_from_envelopes(env).orderBy(F.col("seen_order")).collect()
    assert len(fl) == 3
    first = fl[0]
    assert (first.flight_id, first.flight_number, first.airline_code, first.origin_icao) == \
        ("AI 101", "101", "AI", "VIDP")
    assert first.scheduled_dep == dt.datetime(2025, 11, 20, 6, 5) and first.delay_dep == 15.0
    assert first.actual_arr is None and first.delay_arr is None        # malformed time -> NULL
    assert (first.is_canceled, first.is_cargo) == (1, 0)
    assert (fl[1].flight_id, fl[1].flight_number) == (None, "")        # missing number
    assert fl[2].origin_icao is None and fl[2].scheduled_dep is None   # missing structs
    report = {(r.airport, r.window_idx): r for r in landing.landing_report(env).collect()}
    assert report[("DEL", 0)].departures == 1 and report[("DEL", 1)].arrivals == 2
    assert report[(None, None)].malformed == 1
    assert report[("BOM", 0)].departures == 0


def test_first_seen_order_departures_before_arrivals(spark):
    lines = [json.dumps({"airport": "BOM", "window_idx": 0, "departures": [dict(FLIGHT, number="B 1")]}),
             json.dumps({"airport": "DEL", "window_idx": 1,
                         "departures": [dict(FLIGHT, number="D 2")],
                         "arrivals": [dict(FLIGHT, number="D 3")]}),
             json.dumps({"airport": "DEL", "window_idx": 0, "arrivals": [dict(FLIGHT, number="D 1")]})]
    env = landing.read_envelopes(spark, write_lines(spark, "order-test", lines))
    got = [r.flight_id for r in landing.flights_from_envelopes(env).orderBy("seen_order").collect()]
    # poll order of airports (DEL before BOM), then window, then departures before arrivals
    assert got == ["D 1", "D 2", "D 3", "B 1"]


def test_saved_flight_list_multiline(spark):
    path = new_scratch_path(spark, "raw-list")
    d = local_path(path)
    os.makedirs(d)
    with open(os.path.join(d, "raw_flights.json"), "w") as fh:
        json.dump([FLIGHT, dict(FLIGHT, number="AI 102")], fh, indent=2)
    docs = landing.read_flight_list(spark, path)
    out = landing.flights_from_docs(docs.select(F.struct(*[c for c in docs.columns
                                                           if c != landing.CORRUPT]).alias("f")))
    assert sorted(r.flight_id for r in out.collect()) == ["AI 101", "AI 102"]


def test_airport_docs(spark):
    docs = [{"icao": "VIDP", "iata": "DEL", "shortName": "", "fullName": "Indira Gandhi",
             "municipalityName": "Delhi", "country": {"name": "India"}, "continent": {"name": "Asia"},
             "location": {"lat": 28.5, "lon": 77.1}, "timeZone": "Asia/Kolkata"},
            {"icao": "VABB", "iata": "BOM", "shortName": "Mumbai", "fullName": "Chhatrapati"}]
    ap = landing.airports_from_docs(landing.read_airport_docs(
        spark, write_lines(spark, "airports-test", [json.dumps(x) for x in docs])))
    got = {r.iata_code: r for r in ap.collect()}
    assert got["DEL"].name == "Indira Gandhi" and got["DEL"].latitude == 28.5
    assert got["BOM"].name == "Mumbai" and got["BOM"].country is None


def test_csv_round_trip_keeps_na_text(spark):
    from helpers import airports
    src = airports(spark).withColumn("city", F.when(F.col("iata_code") == "DEL", "NA").otherwise(F.col("city")))
    path = new_scratch_path(spark, "csv-test")
    export_csv(src, path)
    back = {r.iata_code: r for r in landing.read_airports_csv(spark, path).collect()}
    assert back["DEL"].city == "NA" and back["MAA"].country is None and len(back) == 5


def test_publish_replaces_the_whole_table(spark):
    day1, day2 = T0, T0 + dt.timedelta(days=1)
    f = flights(spark, [dict(flight_id="A 1", scheduled_dep=day1), dict(flight_id="A 2", scheduled_dep=day2)])
    f = f.withColumn("flight_date", F.to_date("scheduled_dep"))
    path = new_scratch_path(spark, "publish-test")
    publish_table(f, path, partition_by="flight_date")
    again = flights(spark, [dict(flight_id="A 3", scheduled_dep=day2)]).withColumn(
        "flight_date", F.to_date("scheduled_dep"))
    publish_table(again, path, partition_by="flight_date")
    got = sorted(r.flight_id for r in spark.read.parquet(path).collect())
    assert got == ["A 3"]


def test_merge_replaces_only_what_the_landing_owns(spark):
    """Two polls with overnight and untimed flights: rows of windows that weren't landed
    again stay, though they share a day's folder with new ones."""
    day1, day2 = T0, T0 + dt.timedelta(days=1)

    def landing_of(*rows):
        made = [flights(spark, [dict(flight_id=i, scheduled_dep=d)]).withColumn("window", F.lit(w))
                for i, d, w in rows]
        out = made[0]
        for m in made[1:]:
            out = out.unionByName(m)
        return out.withColumn("flight_date", F.to_date("scheduled_dep"))

    path = new_scratch_path(spark, "merge-test")
    first = landing_of(("A 1", day1, "w1"), ("A 2", day1, "w2"), ("A 3", None, "w1"))
    merge_table(first, path, "flight_date", ["window"])
    merge_table(landing_of(("B 1", day1, "w3"), ("B 2", day2, "w3"), ("B 3", None, "w3")),
                path, "flight_date", ["window"])
    got = sorted(r.flight_id for r in spark.read.parquet(path).collect())
    assert got == ["A 1", "A 2", "A 3", "B 1", "B 2", "B 3"]
    # w3 again, without its flight of day 2: that folder goes
    merge_table(landing_of(("C 1", day1, "w3")), path, "flight_date", ["window"])
    got = sorted(r.flight_id for r in spark.read.parquet(path).collect())
    assert got == ["A 1", "A 2", "A 3", "C 1"]


def test_month_rollup_keeps_its_other_days(spark):
    from flightops.operators import rollups
    path = new_scratch_path(spark, "rollup-test")
    for d in range(3):
        f = flights(spark, [dict(flight_id="A 1", scheduled_dep=T0 + dt.timedelta(days=d))])
        rollups.publish_airport_delays(rollups.airport_delays_daily(f), path, grain="month")
    assert rollups.read_airport_delays(spark, path).count() == 3


@pytest.mark.parametrize("grain", ["day", "month"])
def test_rollup_takes_back_a_day_without_flights(spark, grain):
    from flightops.operators import rollups
    path = new_scratch_path(spark, "rollup-back")
    days = [T0, T0 + dt.timedelta(days=1)]
    f = flights(spark, [dict(flight_id="A 1", scheduled_dep=d) for d in days])
    rollups.publish_airport_delays(rollups.airport_delays_daily(f), path, grain)
    again = flights(spark, [dict(flight_id="A 2", scheduled_dep=days[0])])
    rollups.publish_airport_delays(rollups.airport_delays_daily(again), path, grain,
                                   days=spark.createDataFrame([(d.date(),) for d in days], "delay_date date"))
    assert [r.delay_date for r in rollups.read_airport_delays(spark, path).collect()] == [T0.date()]


def test_aircraft_needs_an_order(spark):
    from flightops.operators.dims import aircraft_dimension
    f = flights(spark, [dict(flight_id="A 1")]).withColumn("seen_order", F.lit(None))
    with pytest.raises(ValueError):
        aircraft_dimension(f)


def test_publish_star_partitioned_by_day(spark):
    from flightops.sources.store import publish_star
    from helpers import airports as make_airports
    day1, day2 = T0, T0 + dt.timedelta(days=1)
    f = flights(spark, [dict(flight_id="A 1", aircraft_reg="R1", aircraft_model="ATR 72", scheduled_dep=day1, seq=2),
                        dict(flight_id="A 2", aircraft_reg="R1", aircraft_model="ATR 42", scheduled_dep=day2, seq=1),
                        dict(flight_id="A 3", aircraft_reg=None, scheduled_dep=None, seq=3)])
    f = f.withColumn("flight_date", F.to_date("scheduled_dep"))
    path = new_scratch_path(spark, "star-test")
    star = publish_star(spark, make_airports(spark), f, path)
    parts = sorted(os.listdir(local_path(f"{path}/flights")))
    assert [p for p in parts if p.startswith("flight_date=")] == [
        "flight_date=2025-11-20", "flight_date=2025-11-21", "flight_date=__HIVE_DEFAULT_PARTITION__"]
    assert star.rows == {"airports": 5, "aircraft": 1}
    assert star.flights.count() == 3
    assert [tuple(r) for r in star.aircraft.collect()] == [("R1", "ATR 42", "ATR", None)]


def test_rollup_day_grain_replaces_one_day(spark):
    from flightops.operators import rollups
    day1, day2 = T0, T0 + dt.timedelta(days=1)
    f = flights(spark, [dict(origin_iata="DEL", scheduled_dep=day1, delay_dep=5.0),
                        dict(origin_iata="DEL", scheduled_dep=day2, delay_dep=1.0),
                        dict(origin_iata="DEL", scheduled_dep=day2, delay_dep=3.0)])
    path = new_scratch_path(spark, "rollup-test")
    rollups.publish_airport_delays(rollups.airport_delays_daily(f), path)
    again = flights(spark, [dict(origin_iata="DEL", scheduled_dep=day2, delay_dep=9.0)])
    rollups.publish_airport_delays(rollups.airport_delays_daily(again), path)
    got = {r.delay_date: (r.total_flights, r.median_delay_min)
           for r in rollups.read_airport_delays(spark, path).collect()}
    assert got == {day1.date(): (1, 5.0), day2.date(): (1, 9.0)}


def test_whole_file_envelopes(spark):
    # one pretty-printed answer per file, as a poller saving raw answers would write it
    root = new_scratch_path(spark, "multiline")
    d = local_path(root)
    os.makedirs(d)
    for i, airport in enumerate(["DEL", "BOM"]):
        with open(os.path.join(d, f"answer-{i}.json"), "w") as fh:
            json.dump({"airport": airport, "window_idx": i, "departures": [dict(FLIGHT, number=f"X {i}")],
                       "arrivals": []}, fh, indent=2)
    env = landing.read_envelopes(spark, root, multi_line=True)
    got = sorted(r.flight_id for r in landing.flights_from_envelopes(env).collect())
    assert got == ["X 0", "X 1"]
    assert landing.landing_report(env).where("malformed > 0").count() == 0


def test_csv_export_time_text(spark):
    import glob
    df = spark.createDataFrame([("X 1", T0, None), ("X 2", None, "")],
                               "flight_number string, scheduled_departure timestamp_ntz, note string")
    path = new_scratch_path(spark, "csv-times")
    export_csv(df.coalesce(1), path)
    lines = open(glob.glob(local_path(path) + "/*.csv")[0]).read().splitlines()
    assert lines == ["flight_number,scheduled_departure,note",
                     "X 1,2025-11-20 06:00:00,", "X 2,,"]


def test_command_line_lists_and_exports(spark, small_sf, capsys):
    from flightops.__main__ import main
    assert main(["--list"]) == 0
    assert "delayed_pct_by_destination" in capsys.readouterr().out.split()
