"""Poll journal, as-of matched answers, unanswered calls (batch and stream), split saved lists."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from flightops.operators.dims import aircraft_dimension
from flightops.session import local_path, new_scratch_path
from flightops.sources import journal, landing, lists
from flightops.streaming import requests

DAY = dt.datetime(2025, 11, 21, 6, 0, 0)
W1, W2 = "2025-11-20T00:00", "2025-11-20T12:00"


def at(seconds, days=0):
    return (DAY + dt.timedelta(days=days, seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


def call(poll, airport, window, attempt, seconds, days=0):
    return {"poll": poll, "airport": airport, "window_idx": 0, "window_from": window, "window_to": "x",
            "attempt": attempt, "requested_at": at(seconds, days)}


def answer(airport, window, seconds, n, days=0, **more):
    return {"airport": airport, "window_idx": 0, "window_from": window, "departures": [{"number": f"F {k}"} for k in range(n)],
            "answered_at": None if seconds is None else at(seconds, days)} | more


def write(folder, name, rows):
    os.makedirs(local_path(folder), exist_ok=True)
    with open(os.path.join(local_path(folder), name), "w") as fh:
        fh.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


@pytest.fixture(scope="module")
def polls(spark):
    """Two polls: a failed call whose retry is answered, a call that fails with its retry, an answer
    that lands after the next poll asked again, and answers that belong to no call."""
    root = new_scratch_path(spark, "journal-test")
    calls = [call("p1", "DEL", W1, 1, 0), call("p1", "DEL", W1, 2, 60), call("p1", "DEL", W2, 1, 120),
             call("p1", "BOM", W1, 1, 180), call("p1", "BOM", W1, 2, 240), call("p1", "BOM", W2, 1, 300),
             call("p2", "DEL", W1, 1, 0, 1), call("p2", "BOM", W1, 1, 60, 1)]
    answers = [answer("DEL", W1, 65, 3), answer("DEL", W1, 66, 2), answer("DEL", W2, 121, 0, arrivals=[{"number": "A"}]),
               answer("DEL", W1, 5, 4, 1), answer("BOM", W2, 340, 7),
               answer("BOM", W1, 0, 9), answer("BOM", None, 400, 9), answer("LHR", W1, 400, 9), answer("DEL", W1, None, 9),
               '{"airport": "DEL", "window_from": ']
    write(f"{root}/calls", "a.json", [*calls, "{broken"])
    write(f"{root}/answers", "a.json", answers)
    return journal.read_calls(spark, f"{root}/calls"), landing.read_envelopes(spark, f"{root}/answers"), root


def test_report_of_each_poll(polls):
    got = {r.poll: tuple(r)[1:] for r in journal.poll_report(*polls[:2]).collect()}
    # calls, answers, errors, retries, unanswered requests, flights
    assert got == {"p1": (6, 3, 3, 2, 1, 13), "p2": (2, 1, 1, 0, 1, 4)}


def test_answers_match_the_last_call_before_them(polls):
    got = {(r.airport, r.window_from, r.at, r.poll, r.attempt) for r in journal.match_answers(*polls[:2]).collect()}

    def t(seconds, days=0):
        return DAY + dt.timedelta(days=days, seconds=seconds)
    assert got == {("DEL", W1, t(65), "p1", 2), ("DEL", W1, t(66), "p1", 2), ("DEL", W2, t(121), "p1", 1),
                   ("DEL", W1, t(5, 1), "p2", 1), ("BOM", W2, t(340), "p1", 1), ("BOM", W1, t(0), None, None),
                   ("LHR", W1, t(400), None, None)}


def test_matching_against_brute_force(spark):
    rng = random.Random(2)
    calls = [call(f"p{k}", rng.choice("AB"), rng.choice([W1, W2]), 1, rng.randrange(500)) for k in range(60)]
    seen = {}
    calls = [seen.setdefault((c["airport"], c["window_from"], c["requested_at"]), c) for c in calls]
    calls = list({c["poll"]: c for c in calls}.values())
    answers = [answer(rng.choice("AB"), rng.choice([W1, W2]), rng.randrange(500), k) for k in range(80)]
    root = new_scratch_path(spark, "journal-brute")
    write(f"{root}/c", "c.json", calls)
    write(f"{root}/a", "a.json", answers)
    got = {r.flights: r.poll for r in journal.match_answers(journal.read_calls(spark, f"{root}/c"),
                                                            landing.read_envelopes(spark, f"{root}/a")).collect()}
    for k, a in enumerate(answers):
        before = [c for c in calls if (c["airport"], c["window_from"]) == (a["airport"], a["window_from"])
                  and c["requested_at"] <= a["answered_at"]]
        assert got[k] == (max(before, key=lambda c: c["requested_at"])["poll"] if before else None)


def test_first_sight_follows_the_polls(spark):
    def flight(model):
        return {"number": "X 1", "aircraft": {"reg": "R1", "model": model}, "airline": {"name": "N"}}
    rows = [{"poll": p, "airport": a, "window_idx": i, "window_from": w, "departures": [flight(m)]}
            for p, a, i, w, m in [("2025-11-21", "DEL", 0, "2025-11-21T00:00", "second DEL"),
                                  ("2025-11-20", "BOM", 1, "2025-11-19T12:00", "first BOM"),
                                  ("2025-11-21", "IXM", 0, "2025-11-20T00:00", "second IXM")]]
    root = new_scratch_path(spark, "poll-order")
    write(root, "a.json", rows)
    flights = landing.flights_from_envelopes(landing.read_envelopes(spark, root))
    assert aircraft_dimension(flights).first().aircraft_model == "first BOM"


def test_with_poll_keeps_every_envelope(polls):
    calls, env, _ = polls
    got = journal.with_poll(calls, env)
    assert got.columns == env.columns and got.count() == env.count()
    assert {r.poll for r in got.where("answered_at is not null and airport = 'DEL'").collect()} == {"p1", "p2"}


def test_days_of_one_window_number_stay_apart(polls):
    env = polls[1].where("airport = 'DEL' and window_from is not null")
    report = {r.window_from: r.answers for r in landing.landing_report(env).collect()}
    assert report == {W1: 4, W2: 1}


def test_unanswered_calls_in_batch_and_as_stream(spark, polls):
    calls, env, root = polls
    batch = sorted((r.poll, r.airport, r.window_from, r.attempt) for r in journal.unanswered_calls(calls, env).collect())
    # the answer 40 seconds after its call came too late
    assert batch == [("p1", "BOM", W1, 1), ("p1", "BOM", W1, 2), ("p1", "BOM", W2, 1), ("p1", "DEL", W1, 1), ("p2", "BOM", W1, 1)]
    sink, checkpoint = f"{root}/sink", f"{root}/checkpoint"

    def run():
        requests.run_unanswered(spark, f"{root}/calls", f"{root}/answers", sink, checkpoint, delay="1 hour")

    def so_far():
        return sorted((r.poll, r.airport, r.window_from, r.attempt) for r in requests.unanswered_so_far(
            spark, sink, journal.read_calls(spark, f"{root}/calls"), landing.read_envelopes(spark, f"{root}/answers"), delay="1 hour").collect())
    run()
    assert so_far() == batch
    # a day later the stream itself has closed all of these, and puts none out twice
    write(f"{root}/calls", "b.json", [call("p3", "DEL", W1, 1, 0, 3)])
    write(f"{root}/answers", "b.json", [answer("DEL", W1, 4, 1, 3)])
    run()
    closed = sorted((r.poll, r.airport, r.window_from, r.attempt) for r in spark.read.parquet(sink).collect())
    assert closed == batch == so_far()


def _value(rng, depth=0):
    kind = rng.randrange(6)
    if kind == 0:
        return rng.choice(["}", "{", '"', "\\", 'a"}{[', 'x\\"}', "é}", "[]", "\n", "\\\\"])
    if kind == 1 and depth < 3:
        return {rng.choice('abc"}'): _value(rng, depth + 1) for _ in range(rng.randrange(3))}
    if kind == 2 and depth < 3:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return rng.choice([None, 1, True, "text"])


def test_lists_cut_anywhere_give_all_documents_in_order(spark):
    rng, root, want = random.Random(3), new_scratch_path(spark, "lists"), []
    os.makedirs(local_path(root))
    for k, n in enumerate([0, 1, 200, 600]):
        docs = [{"n": j, "v": _value(rng), "e": {}} for j in range(n)]
        want += [json.dumps(d, sort_keys=True) for d in docs]
        with open(os.path.join(local_path(root), f"{k}.json"), "w") as fh:
            json.dump(docs, fh, indent=[None, None, None, 2][k], ensure_ascii=False)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in ("150", "3000", "10m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = lists.list_documents(spark, root).collect()
            assert sorted(json.dumps(json.loads(r.text), sort_keys=True) for r in got) == sorted(want)
            rows = sorted((r.file, r.pos, json.loads(r.text)["n"]) for r in got)
            assert all(a[0] != b[0] or a[2] + 1 == b[2] for a, b in zip(rows, rows[1:], strict=False))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_split_reader_equals_the_sequential_one(spark):
    docs = [{"number": f"A {k}", "status": None if k % 3 else 'In "air" }{', "aircraft": {"reg": f"R{k % 40}", "model": "ATR \\ 72"},
             "departure": {"airport": {"icao": "VIDP"}, "scheduledTime": {"utc": "2025-11-20 06:00Z"}}} for k in range(30_000)]
    root = new_scratch_path(spark, "long-list")
    os.makedirs(local_path(root))
    with open(os.path.join(local_path(root), "raw_flights.json"), "w") as fh:
        json.dump(docs, fh)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        split = lists.read_flight_list_split(spark, root)
        # one file, many tasks
        assert spark.read.option("lineSep", "}").text(root).rdd.getNumPartitions() >= 8
        flights = landing.flights_from_list(split).drop("seen_order")
        whole = landing.flights_from_list(landing.read_flight_list(spark, root)).drop("seen_order")
        assert flights.count() == 30_000 and flights.exceptAll(whole).isEmpty() and whole.exceptAll(flights).isEmpty()
        order = [r.flight_id for r in landing.flights_from_list(split).orderBy("seen_order").select("flight_id").collect()]
        assert order == [d["number"] for d in docs]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    write(root, "raw_flights.json", ['[{"number": "X 1"}, {"number": "X 2", "status": {"a": '])
    assert lists.read_flight_list_split(spark, root).where(F.col("number") == "X 1").count() == 1
