"""Streaming = batch, incremental ingest, de-duplication."""

import json
import os

from pyspark.sql import functions as F


from flightops import registry
from flightops.session import local_path, new_scratch_path
from flightops.streaming import dedup, windows
from test_ingest import FLIGHT


def test_window_stream_equals_batch_on_closed_windows(spark, small_sf):
    stream = registry.events_12h_windows_stream(spark, small_sf)
    batch = registry.events_12h_windows(spark, small_sf)
    joined = stream.join(batch, ["window_start", "window_end"])
    assert joined.count() == stream.count() == batch.count()
    for c in ("n_events", "n_users", "window_label"):
        assert joined.where(stream[c] != batch[c]).count() == 0


def test_late_events_are_counted(spark):
    root = new_scratch_path(spark, "late-events")
    rows = lambda *ts: spark.createDataFrame([(t, 1) for t in ts], "ts string, user_id long").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id").coalesce(1)

    def run(df):
        df.write.mode("append").parquet(f"{root}/in")
        windows.stream_event_window_counts(spark, f"{root}/in", "*.parquet", f"{root}/out", f"{root}/ckpt")
    run(rows("2025-01-01 01:00:00", "2025-01-01 02:00:00", "2025-01-02 09:00:00"))
    run(rows("2025-01-01 03:00:00", "2025-01-02 10:00:00"))
    closed, events = spark.read.parquet(f"{root}/out"), spark.read.parquet(f"{root}/in")
    assert [(r.n_events, r.n_users) for r in closed.collect()] == [(2, 1)]
    assert windows.late_events(closed, events).first().late_events == 1
    got = windows.event_windows_so_far(closed, events).collect()
    assert sorted((r.window_label, r.n_events) for r in got) == [("Morning", 2), ("Morning", 2)]


def test_missing_windows_grid(spark, small_sf):
    mw = registry.missing_windows(spark, small_sf)
    assert set(r.window_label for r in mw.collect()) <= {"Morning", "Evening"}
    assert mw.count() <= 12 * 3 * 2


def _land(root, name, envelopes):
    d = local_path(root)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as fh:
        fh.write("\n".join(json.dumps(e) for e in envelopes) + "\n")


def test_dedup_is_incremental_and_keeps_untimed_rows(spark):
    landing_dir = new_scratch_path(spark, "dedup-landing")
    root = new_scratch_path(spark, "dedup-out")
    paths = dedup.DedupPaths(f"{root}/flights", f"{root}/untimed", f"{root}/ckpt")
    untimed = dict(FLIGHT, number="XX 9")
    untimed["departure"] = {"airport": {"iata": "DEL", "icao": "VIDP"}}
    # the same flight as a departure of DEL and an arrival of BOM, plus an untimed row
    _land(landing_dir, "a.json", [{"airport": "DEL", "window_idx": 0, "departures": [FLIGHT, untimed]},
                                  {"airport": "BOM", "window_idx": 0, "arrivals": [FLIGHT]}])
    dedup.run_dedup_ingest(spark, landing_dir, paths)
    assert spark.read.parquet(paths.sink).count() == 1
    assert spark.read.parquet(paths.untimed).count() == 1
    # a later poll returns it again at the window edge, plus a new flight
    _land(landing_dir, "b.json", [{"airport": "DEL", "window_idx": 1,
                                   "departures": [FLIGHT, dict(FLIGHT, number="AI 202")]}])
    dedup.run_dedup_ingest(spark, landing_dir, paths)
    got = sorted(r.flight_id for r in spark.read.parquet(paths.sink).collect())
    assert got == ["AI 101", "AI 202"]


def test_late_rows_are_kept_in_bronze_and_reconciled(spark):
    import datetime as dt
    landing_dir = new_scratch_path(spark, "late-landing")
    root = new_scratch_path(spark, "late-out")
    paths = dedup.DedupPaths(f"{root}/flights", f"{root}/untimed", f"{root}/ckpt")

    def at(number, day):
        t = (dt.datetime(2025, 11, 1, 6, 5) + dt.timedelta(days=day)).strftime("%Y-%m-%d %H:%MZ")
        f = json.loads(json.dumps(FLIGHT))
        f["number"] = number
        f["departure"]["scheduledTime"]["utc"] = t
        return f

    _land(landing_dir, "a.json", [{"airport": "DEL", "window_idx": 0, "departures": [at("A 1", 20)]}])
    dedup.run_dedup_ingest(spark, landing_dir, paths, delay="3 days")
    # a re-poll of two weeks earlier arrives after the watermark has passed it
    _land(landing_dir, "b.json", [{"airport": "DEL", "window_idx": 1,
                                   "departures": [at("B 2", 0), at("B 2", 0)]}])
    dedup.run_dedup_ingest(spark, landing_dir, paths, delay="3 days")
    streamed = sorted(r.flight_id for r in spark.read.parquet(paths.sink).collect())
    exact = sorted(r.flight_id for r in dedup.reconcile_dedup(spark, paths).collect())
    assert spark.read.parquet(paths.bronze).count() == 3   # every landed row kept
    assert exact == ["A 1", "B 2"]                          # nothing lost, repeat removed
    assert streamed == ["A 1"]                              # the stream dropped the late row


def test_hot_key_is_salted_across_state_tasks(spark):
    landing_dir = new_scratch_path(spark, "hot-landing")
    root = new_scratch_path(spark, "hot-out")
    paths = dedup.DedupPaths(f"{root}/flights", f"{root}/untimed", f"{root}/ckpt")
    # one flight landed 300 times (different windows), plus one ordinary flight
    hot = [{"airport": "DEL", "window_idx": i, "departures": [FLIGHT]} for i in range(300)]
    _land(landing_dir, "hot.json", hot + [{"airport": "BOM", "window_idx": 0,
                                           "departures": [dict(FLIGHT, number="AI 7")]}])
    dedup.run_dedup_ingest(spark, landing_dir, paths, salt_buckets=4)
    got = sorted(r.flight_id for r in spark.read.parquet(paths.sink).collect())
    assert got == ["AI 101", "AI 7"]


def test_missing_windows_are_requests_without_an_answer(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    from flightops.sources import landing
    from flightops.streaming import windows
    from helpers import airports
    landing_dir = new_scratch_path(spark, "missing-landing")
    # only BOM's morning was asked, and its answer holds one arrival from DEL
    _land(landing_dir, "a.json", [{"airport": "BOM", "window_idx": 0, "window_from": "2025-11-20T00:00",
                                   "window_to": "2025-11-20T12:00", "arrivals": [FLIGHT]}])
    polled = airports(spark).where("iata_code IN ('DEL', 'BOM')")
    got = windows.missing_windows(landing.read_envelopes(spark, landing_dir), polled,
                                  F.lit(dt.date(2025, 11, 20)), days_back=1)
    assert sorted((r.airport_iata, r.window_label) for r in got.collect()) == [
        ("BOM", "Evening"), ("DEL", "Evening"), ("DEL", "Morning")]


def test_poll_requests_texts(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    from flightops.streaming import windows
    from helpers import airports
    req = windows.poll_requests(airports(spark).where("iata_code = 'DEL'"),
                                F.lit(dt.date(2025, 11, 20)), days_back=2)
    got = sorted((r.window_idx, r.window_label, r.window_from, r.window_to) for r in req.collect())
    assert got == [(0, "Morning", "2025-11-20T00:00", "2025-11-20T12:00"),
                   (1, "Evening", "2025-11-20T12:00", "2025-11-20T23:59"),
                   (2, "Morning", "2025-11-19T00:00", "2025-11-19T12:00"),
                   (3, "Evening", "2025-11-19T12:00", "2025-11-19T23:59")]


def test_flights_of_files_out_of_time_order_are_all_kept(spark, monkeypatch):
    import datetime as dt
    landing_dir = new_scratch_path(spark, "order-landing")
    root = new_scratch_path(spark, "order-out")
    paths = dedup.DedupPaths(f"{root}/flights", f"{root}/untimed", f"{root}/ckpt")

    def at(number, day):
        t = (dt.datetime(2025, 11, 1, 6, 5) + dt.timedelta(days=day)).strftime("%Y-%m-%d %H:%MZ")
        f = json.loads(json.dumps(FLIGHT))
        f["number"] = number
        f["departure"]["scheduledTime"]["utc"] = t
        return f

    untimed = dict(FLIGHT, number="U 1", departure={"airport": {"iata": "DEL", "icao": "VIDP"}})
    days = [50, 0, 30, 70, 10, 40]
    for k, day in enumerate(days):
        # each flight twice in its file, and again in the next one
        found = [at(f"A {day}", day)] * 2 + ([at(f"A {days[k - 1]}", days[k - 1])] if k else [untimed])
        name = f"{k}.json"
        _land(landing_dir, name, [{"airport": "DEL", "window_idx": k, "departures": found}])
        os.utime(os.path.join(local_path(landing_dir), name), (1_700_000_000 + k, 1_700_000_000 + k))
    want = sorted([f"A {d}" for d in days] + ["U 1"])
    dedup.run_dedup_ingest(spark, landing_dir, paths, max_files_per_trigger=1)
    monkeypatch.setattr(registry, "dedup_run", lambda *_: paths)
    assert sorted(r.flight_id for r in registry.stream_dedup_flights(spark, "").collect()) == want
    # a later run adds new late flights, and none twice
    _land(landing_dir, "later.json", [{"airport": "DEL", "window_idx": 9,
                                       "departures": [at("A 10", 10), at("B 5", 5), at("B 5", 5)]}])
    dedup.run_dedup_ingest(spark, landing_dir, paths, max_files_per_trigger=1)
    assert sorted(r.flight_id for r in registry.stream_dedup_flights(spark, "").collect()) \
        == sorted([*want, "B 5"])


def test_late_flights_are_looked_up_in_their_days_only(spark):
    import contextlib
    import datetime as dt
    import io
    from pyspark.sql import functions as F
    landing_dir = new_scratch_path(spark, "bounded-landing")
    root = new_scratch_path(spark, "bounded-out")
    paths = dedup.DedupPaths(f"{root}/flights", f"{root}/untimed", f"{root}/ckpt")

    def at(number, day):
        f = json.loads(json.dumps(FLIGHT))
        f["number"] = number
        f["departure"]["scheduledTime"]["utc"] = (dt.datetime(2025, 1, 1, 6, 5) + dt.timedelta(days=day)).strftime("%Y-%m-%d %H:%MZ")
        return f
    assert dedup.streamed_dedup(spark, paths).count() == 0
    _land(landing_dir, "a.json", [{"airport": "DEL", "window_idx": k, "departures": [at(f"A {k}", k)]} for k in range(40)])
    dedup.run_dedup_ingest(spark, landing_dir, paths)
    seen = []
    real = dedup.late_flights

    def watched(new, of):
        out = real(new, of)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            out.explain("formatted")
        seen.append((sorted(r[0] for r in new.select(dedup.DEPARTS).distinct().collect()), set(new.inputFiles()), buf.getvalue()))
        return out
    dedup.late_flights = watched
    try:
        _land(landing_dir, "b.json", [{"airport": "DEL", "window_idx": 50, "departures": [at("B 7", 7), at("A 9", 9)]}])
        dedup.run_dedup_ingest(spark, landing_dir, paths)
    finally:
        dedup.late_flights = real
    days, files, plan = seen[0]
    # the batch holds the new file's rows alone, and history is pruned to its two days by literals
    assert len(seen) == 1 and days == ["2025-01-08", "2025-01-10"]
    filters = [x for x in plan.splitlines() if x.startswith("PartitionFilters")]
    assert len(filters) == 2 and all("IN (2025-01-08,2025-01-10)" in x for x in filters), filters
    got = sorted(r.flight_id for r in dedup.streamed_dedup(spark, paths).collect())
    assert got == sorted([f"A {k}" for k in range(40)] + ["B 7"])
    assert spark.read.parquet(paths.late).where(F.col("flight_id") == "B 7").count() == 1
