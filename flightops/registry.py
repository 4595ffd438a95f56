"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each reads the star published (once per application) from the driver tables in
``sf_dir``; parameters are the fixture values of ``flightops.params.FIXTURE``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops import schemas
from flightops.operators import audit, cluster, rollups, sketches
from flightops.operators.dims import aircraft_dimension
from flightops.params import FIXTURE as P
from flightops.plans import dashboard as H
from flightops.plans import reports as Q
from flightops.session import new_scratch_path
from flightops.sources import fixture, journal, landing, lists, versions
from flightops.sources.sinks import export_csv
from flightops.sources.store import Star, open_star, publish_from_landing, warehouse
from flightops.streaming import dedup, requests, windows

Query = Callable[[SparkSession, str], DataFrame]


def _on_star(fn: Callable[[Star], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(warehouse(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


STAR_QUERIES: dict[str, Callable[[Star], DataFrame]] = {
    "aircraft_dim": lambda s: aircraft_dimension(s.flights).select(*schemas.AIRCRAFT_COLUMNS),
    "flights_per_model": lambda s: Q.flights_per_model(s.flights, s.aircraft),
    "busy_aircraft": lambda s: Q.busy_aircraft(s.flights, s.aircraft, P["busy_min_flights"]),
    "outbound_airports": lambda s: Q.outbound_airports(s.flights, s.airports_dim,
                                                       P["outbound_min_flights"]),
    "top_destinations": lambda s: Q.top_destinations(s.flights, s.airports_dim,
                                                     P["top_destinations_k"]),
    "flight_type": lambda s: Q.flight_type(s.flights, s.airports_dim, P["flight_type_limit"]),
    "flight_type_counts": lambda s: Q.flight_type_counts(s.flights, s.airports_dim),
    "latest_arrivals": lambda s: Q.latest_arrivals(s.flights, s.aircraft_dim, s.airports_dim,
                                                   P["latest_arrivals_iata"], P["latest_arrivals_k"]),
    "airports_without_arrivals": lambda s: Q.airports_without_arrivals(s.flights, s.airports),
    "status_by_airline": lambda s: Q.status_by_airline(s.flights),
    "cancelled_flights": lambda s: Q.cancelled_flights(s.flights, s.airports_dim,
                                                       P["cancelled_status"]),
    "city_pair_models": lambda s: Q.city_pair_models(s.flights, s.airports_dim, s.aircraft,
                                                     P["city_pair_min_models"], P["city_pair_k"]),
    "delayed_pct_by_destination": lambda s: Q.delayed_pct_by_destination(s.flights, s.airports_dim),
    "kpis": lambda s: H.kpis(s.flights, s.aircraft, s.airports),
    "status_distribution": lambda s: H.status_distribution(s.flights),
    "top_airlines": lambda s: H.top_airlines(s.flights, P["top_airlines_k"]),
    "facet_airlines": lambda s: H.facet_airlines(s.flights),
    "facet_statuses": lambda s: H.facet_statuses(s.flights),
    "facet_airports": lambda s: H.facet_airports(s.airports),
    "explore_base": lambda s: H.explore_base(s.flights, s.airports_dim, P["explore_airline"]),
    "explore_table": lambda s: H.explore_table(s.flights, s.airports_dim, P["explore_airline"],
                                               P["explore_status"], None, P["explore_limit"]),
    "explore_metrics": lambda s: H.explore_metrics(s.flights, s.airports_dim, P["explore_airline"]),
    "fleet_models": lambda s: H.fleet_models(s.flights, s.aircraft, P["fleet_models_k"]),
    "manufacturers": lambda s: H.manufacturers(s.aircraft),
    "airport_list": lambda s: H.airport_list(s.airports),
    "airport_detail": lambda s: H.airport_detail(s.airports, P["airport_detail_iata"]),
    "delay_overview": lambda s: H.delay_overview(s.flights),
    "delays_by_airport": lambda s: H.delays_by_airport(s.flights, s.airports_dim,
                                                       P["delays_min_flights"]),
    "airport_delays_daily": lambda s: rollups.airport_delays_daily(s.flights),
    "table_profile": lambda s: audit.table_profile(s.flights, "flights", schemas.FLIGHT_COLUMNS),
}


# ------------------------------------------------------------------ landed-file queries

LANDING_RECORDS_PER_FILE = 16_384
_ONCE: dict[tuple, object] = {}
_ONCE_LOCK = threading.RLock()


def _once(spark: SparkSession, sf_dir: str, tag: str, make: Callable[[str], object]):
    """What ``make(fresh path)`` returns (None: the path), made once per application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), tag)
    with _ONCE_LOCK:
        if key not in _ONCE:
            path = new_scratch_path(spark, tag)
            made = make(path)
            _ONCE[key] = path if made is None else made
        return _ONCE[key]


def _landed(lines: DataFrame):
    """A writer of landed lines: many modest files, as a poller lands them, compressed (lines repeat
    their field names and little else is new). Such a file is read by one task; JSON parsing is
    CPU-bound, so the read spreads evenly over the cores instead of a few large files."""
    return lines.write.option("maxRecordsPerFile", LANDING_RECORDS_PER_FILE).option("compression", "gzip")


#: Bytes of published flights that are landed in one turn, and turns at most: each scans the flights again.
TURN_BYTES, MAX_TURNS = 32 << 20, 4


def _turns(spark: SparkSession, star: Star, turn_bytes: int = TURN_BYTES) -> int:
    """Turns in which the flights are written anew, few where they are few."""
    return min(MAX_TURNS, 1 + versions.folder_bytes(spark, f"{star.path}/flights") // turn_bytes)


def landed_path(spark: SparkSession, sf_dir: str, both_ends: bool = False) -> str:
    """Landing folder of envelopes built from the published fixture flights; written once
    per application and mode."""
    def make(path: str) -> None:
        star = warehouse(spark, sf_dir)
        for flights in fixture.by_turns(star.flights, _turns(spark, star)):
            _landed(fixture.landed_envelopes(flights, both_ends)).mode("append").json(path)
    return _once(spark, sf_dir, "landing-both" if both_ends else "landing", make)


def _airport_docs_path(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "airport-docs",
                 lambda path: fixture.airport_docs(warehouse(spark, sf_dir).airports).write.json(path))


def ingest_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-2: landed envelopes -> flights (19 columns); equals the fixture flights."""
    env = landing.read_envelopes(spark, landed_path(spark, sf_dir))
    return landing.flights_from_envelopes(env).select(*schemas.FLIGHT_COLUMNS)


def landing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-3: answers, malformed lines, departures and arrivals per (airport, window)."""
    return landing.landing_report(landing.read_envelopes(spark, landed_path(spark, sf_dir)))


def landing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-3 per airport: answers, malformed lines, flights received."""
    return landing.landing_totals(landing.read_envelopes(spark, landed_path(spark, sf_dir)))


def landing_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-3 by reason, over a landing with broken lines, wrong types, bad times and answers
    without flights (all fixture flights, damaged by rule)."""
    path = _once(spark, sf_dir, "landing-damaged", lambda p: _landed(fixture.damaged_landing(
        warehouse(spark, sf_dir).flights)).text(p))
    return landing.landing_rejects(landing.read_envelopes(spark, path))


def restore_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4: flights saved as whole-file JSON lists, read back."""
    path = _once(spark, sf_dir, "saved-lists", lambda p: fixture.saved_lists(
        warehouse(spark, sf_dir).flights).write.option("maxRecordsPerFile", 1)
        .option("compression", "gzip").text(p))
    return landing.flights_from_list(landing.read_flight_list(spark, path)).select(*schemas.FLIGHT_COLUMNS)


def restore_long_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4: flights saved as long lists (some million flights a file), each read by many tasks."""
    def make(path: str) -> None:
        star = warehouse(spark, sf_dir)
        # a list is one task's: a turn holds several
        fixture.write_long_lists(star.flights, path, _turns(spark, star, 8 * TURN_BYTES))
    path = _once(spark, sf_dir, "long-lists", make)
    docs = lists.read_flight_list_split(spark, path)
    return landing.flights_from_list(docs).select(*schemas.FLIGHT_COLUMNS)


def ingest_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1: airport documents -> airports; equals the fixture airports."""
    return landing.airports_from_docs(landing.read_airport_docs(spark, _airport_docs_path(spark, sf_dir)))


def ingest_airports_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10 then S-5: airports exported as CSV and read back."""
    path = _once(spark, sf_dir, "airports-csv", lambda p: export_csv(warehouse(spark, sf_dir).airports, p))
    return landing.read_airports_csv(spark, path)


def cancelled_flights_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10 on a report with times and NULLs: Q-9 exported as CSV and read back (an empty
    text comes back as NULL)."""
    star = warehouse(spark, sf_dir)
    report = Q.cancelled_flights(star.flights, star.airports_dim, P["cancelled_status"], ordered=False)
    path = _once(spark, sf_dir, "cancelled-csv", lambda p: export_csv(report, p))
    return (spark.read.schema(report.schema).option("header", True).option("nullValue", "")
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def landed_star_delayed_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: landed airport documents and envelopes -> published star (production
    path, S-1 + S-2 + S-6) -> Q-11 on it. Equals Q-11 on the fixture star."""
    star = _once(spark, sf_dir, "landed-star", lambda p: publish_from_landing(
        spark, _airport_docs_path(spark, sf_dir), landed_path(spark, sf_dir), p,
        flights_partition_by=None))
    return Q.delayed_pct_by_destination(star.flights, star.airports_dim)


def merged_star(spark: SparkSession, sf_dir: str) -> Star:
    """Landings that overlap, published one after the other as versions of a star partitioned by
    month. The first holds a third of the requests, stale and shorter answers of a second third, half
    of the answers without a window, and all airports but one. The second answers the stale requests
    again, the last third, the other answers without a window, and brings the missing airport.
    A third writes stale answers of everything and stops before its version is made. The
    last one answers one airport's requests again and brings that airport alone. Month
    folders because the fixture spans seven years with a few hundred flights a day at most.

    The landed lines are parsed once, for all four are made of them."""
    def make(path: str) -> Star:
        parsed = new_scratch_path(spark, "answers")
        env = landing.read_envelopes(spark, landed_path(spark, sf_dir))
        env.write.option("compression", "zstd").parquet(parsed)
        env = spark.read.schema(env.schema).parquet(parsed)
        airports = warehouse(spark, sf_dir).airports
        timed = F.col("window_from").isNotNull()
        third = F.pmod(F.xxhash64("airport", "window_from"), F.lit(3))
        half = F.size(F.coalesce("departures", F.array())) % 2 == 0
        stale = {"departures": F.slice("departures", 1, 1), "arrivals": F.lit(None).cast(env.schema["arrivals"].dataType)}
        one = F.col("iata_code") == P["airport_detail_iata"]

        def prepared(landed: DataFrame, of: DataFrame, first: bool = False) -> versions.Version:
            flights = landing.flights_from_envelopes(landed)
            flights = flights.withColumn(schemas.FLIGHT_MONTH, F.date_format(schemas.FLIGHT_DATE, "yyyy-MM"))
            if first:
                return versions.prepare_replace(spark, path, of, flights)
            return versions.prepare_merge(spark, path, flights, of, landing.answered_requests(landed))
        versions.commit(spark, path, prepared(
            env.where((timed & (third == 0)) | (~timed & half)).unionByName(env.where(timed & (third == 1)).withColumns(stale)),
            airports.where(~one), first=True))
        versions.commit(spark, path, prepared(env.where((timed & (third > 0)) | (~timed & ~half)), airports.where(one)))
        prepared(env.withColumns(stale), airports.where(one))   # a writer that stops half-way
        versions.drop_unreferenced(spark, path)   # what the stopped writer left
        versions.commit(spark, path, prepared(
            env.where(timed & (F.col("airport") == P["airport_detail_iata"])), airports.where(one)))
        versions.drop_unreferenced(spark, path)   # the first version
        versions.remove(spark, parsed)
        return open_star(spark, path)
    return _once(spark, sf_dir, "merged-star", make)


def incremental_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-6 merge: all flights after two overlapping landings; equals the fixture flights."""
    return merged_star(spark, sf_dir).flights.select(*schemas.FLIGHT_COLUMNS)


def landed_aircraft_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-8 on the production path: the aircraft dimension of the merged landings, by first
    sight in poll order."""
    return merged_star(spark, sf_dir).aircraft.select(*schemas.AIRCRAFT_COLUMNS)


def incremental_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-6 merge: the airports after landings that each bring some of them."""
    return merged_star(spark, sf_dir).airports


def incremental_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-9 maintained by landings: equals the rollup of all flights."""
    path = merged_star(spark, sf_dir).path
    delays = versions.read_table(spark, path, versions.read_version(spark, path), "delays")
    return delays.select(*[f.name for f in schemas.AIRPORT_DELAYS.fields])


def explore_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-5 on a clustered copy of the fact (Z-order inside a month): the same rows."""
    star = warehouse(spark, sf_dir)
    by_month = star.flights.withColumn(schemas.FLIGHT_MONTH, F.date_format(schemas.FLIGHT_DATE, "yyyy-MM"))
    path = _once(spark, sf_dir, "clustered", lambda p: cluster.write_clustered(by_month, p, schemas.FLIGHT_MONTH))
    return H.explore_table(spark.read.parquet(path), star.airports_dim, P["explore_airline"], P["explore_status"],
                           None, P["explore_limit"])


def distinct_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-1..H-4 and M-1 by quarter: exact counts, and whether the united daily sketches of
    the merged star lie within four standard errors of them."""
    star = merged_star(spark, sf_dir)
    daily = versions.read_table(spark, star.path, versions.read_version(spark, star.path), "sketches")
    day = F.col(schemas.FLIGHT_DATE)
    quarter = F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")).alias("quarter")
    estimated = sketches.united(daily.where(day.isNotNull()), quarter)
    exact = sketches.exact_counts(star.flights.where(day.isNotNull()), quarter)
    names = list(sketches.MEASURES.values())
    joined = exact.join(estimated.select("quarter", *[F.col(n).alias(f"_{n}") for n in names]), "quarter")
    near = [(F.abs(F.col(f"_{n}") - F.col(n)) <= F.greatest(F.col(n) * 4 * sketches.ERROR, F.lit(0.5))).alias(f"{n}_near") for n in names]
    return joined.select("quarter", "n_flights", *names, *near)


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-7: the violating rows kept at publish, counted per constraint; equals the audit where
    that counts any."""
    star = warehouse(spark, sf_dir)
    path = _once(spark, sf_dir, "quarantine", lambda p: audit.keep_violations(audit.violations(
        star.flights, star.airports, star.aircraft, _published_delays(spark, sf_dir)), p, "first"))
    return audit.violation_counts(spark.read.parquet(path).where("landing = 'first'"))


def _polled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Journal and answers of the fixture's polls, landed once per application."""
    def make(path: str) -> None:
        env = landing.read_envelopes(spark, landed_path(spark, sf_dir))
        calls = fixture.poll_calls(env)
        _landed(calls.drop("ok").withColumn("requested_at", F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss"))).json(f"{path}/calls")
        _landed(fixture.polled_answers(env, calls)).json(f"{path}/answers")
    path = _once(spark, sf_dir, "polls", make)
    return journal.read_calls(spark, f"{path}/calls"), landing.read_envelopes(spark, f"{path}/answers"), path


def poll_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-3 per poll: calls, answers, errors, retries, unanswered requests, flights."""
    calls, answers, _ = _polled(spark, sf_dir)
    return journal.poll_report(calls, answers)


def unanswered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 (batch): calls without an answer in time."""
    calls, answers, _ = _polled(spark, sf_dir)
    return journal.unanswered_calls(calls, answers)


def unanswered_calls_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 as a stream-stream join of calls with answers; equals the batch."""
    calls, answers, path = _polled(spark, sf_dir)
    sink = _once(spark, sf_dir, "unanswered", lambda p: requests.run_unanswered(
        spark, f"{path}/calls", f"{path}/answers", p, f"{p}-checkpoint"))
    return requests.unanswered_so_far(spark, sink, calls, answers)


def explore_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-4 over a range of days of the partitioned fact: only those months are read."""
    star = merged_star(spark, sf_dir)
    days = H.flights_between(star.flights, P["explore_since"], P["explore_until"])
    return H.explore_base(days, star.airports_dim)


def _published_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rollup as published, once per application. The fixture spans seven years
    with about a dozen rollup rows per day, so it is partitioned by month."""
    path = _once(spark, sf_dir, "airport-delays", lambda p: rollups.publish_airport_delays(
        rollups.airport_delays_daily(warehouse(spark, sf_dir).flights), p, grain="month"))
    return rollups.read_airport_delays(spark, path)


def airport_delays_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-6 on A-9: the daily rollup published and read back from Parquet."""
    return _published_delays(spark, sf_dir)


def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-7: the declared constraints, checked on the published star and rollup."""
    star = warehouse(spark, sf_dir)
    return audit.constraint_audit(star.flights, star.airports, star.aircraft,
                                  _published_delays(spark, sf_dir))


def poll_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1: the requests of a poll over the last days of the data (airports x days x 2)."""
    star = warehouse(spark, sf_dir)
    last_day = star.flights.agg(F.max(F.to_date("scheduled_dep"))).scalar()
    return windows.poll_requests(star.airports, last_day, P["window_days_back"])


def missing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 (batch): requests of the last days without a landed answer."""
    star = warehouse(spark, sf_dir)
    last_day = star.flights.agg(F.max(F.to_date("scheduled_dep"))).scalar()
    env = landing.read_envelopes(spark, landed_path(spark, sf_dir))
    return windows.missing_windows(env, star.airports, last_day, P["window_days_back"])


def events_12h_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 on the events table: tumbling 12-hour counts (batch)."""
    return windows.event_window_counts(fixture.read_table(spark, sf_dir, "events"))


def events_12h_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 as a Structured Streaming job (file source, watermark, append): the windows
    closed by the watermark when the available input is exhausted, and those still open."""
    def make(sink: str) -> None:
        schema = fixture.read_table(spark, sf_dir, "events").schema
        windows.stream_event_window_counts(spark, sf_dir.rstrip("/"), "events.parquet", sink,
                                           f"{sink}-checkpoint", P["events_watermark"], schema)
    closed = spark.read.parquet(_once(spark, sf_dir, "events-windows", make))
    return windows.event_windows_so_far(closed, fixture.read_table(spark, sf_dir, "events"))


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1: events that land behind the watermark, counted. The later half of the days lands and
    runs first, the earlier half lands when its windows are closed."""
    events = fixture.read_table(spark, sf_dir, "events")

    def make(root: str) -> None:
        day = F.to_date("ts")
        first, last = events.agg(F.min(day), F.max(day)).first()
        half = F.date_add(F.lit(first), (last - first).days // 2).cast("timestamp_ntz")
        for part in (F.col("ts") >= half, F.col("ts") < half):
            events.where(part).write.mode("append").parquet(f"{root}/landed")
            windows.stream_event_window_counts(spark, f"{root}/landed", "*.parquet", f"{root}/closed",
                                               f"{root}/checkpoint", P["events_watermark"], events.schema)
    closed = spark.read.parquet(_once(spark, sf_dir, "late-events", make) + "/closed")
    return windows.late_events(closed, events)


def dedup_run(spark: SparkSession, sf_dir: str) -> dedup.DedupPaths:
    """Run the streaming de-duplicating ingest over the doubly-landed fixture once per
    application; both ST-2 queries read its outputs."""
    def make(root: str) -> dedup.DedupPaths:
        landed = landed_path(spark, sf_dir, both_ends=True)
        slices = min(MAX_TURNS, 1 + versions.folder_bytes(spark, landed) // (2 * TURN_BYTES))
        paths = dedup.DedupPaths(f"{root}/flights", f"{root}/untimed", f"{root}/checkpoint", slices)
        dedup.run_dedup_ingest(spark, landed, paths,
                               P["dedup_delay"], salt_buckets=P["dedup_salt_buckets"], grain="yyyy")
        return paths
    return _once(spark, sf_dir, "dedup", make)


def stream_dedup_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2: every flight lands twice (origin departure, destination arrival); the
    streaming ingest keeps one row per flight key, those behind the watermark and the rows
    without a complete key in side tables. Key columns of all of them returned."""
    return dedup.streamed_dedup(spark, dedup_run(spark, sf_dir)).select(
        *dedup.DEDUP_KEYS, "flight_number")


def reconcile_dedup_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2 batch form: bronze (every landed row) reduced to the first-seen row per flight
    key. Key columns returned."""
    return dedup.reconcile_dedup(spark, dedup_run(spark, sf_dir), [*dedup.DEDUP_KEYS, "flight_number"])


FILE_QUERIES: dict[str, Query] = {
    "ingest_flights": ingest_flights,
    "landing_report": landing_report,
    "landing_totals": landing_totals,
    "landing_rejects": landing_rejects,
    "restore_flights": restore_flights,
    "restore_long_lists": restore_long_lists,
    "cancelled_flights_csv": cancelled_flights_csv,
    "incremental_publish": incremental_publish,
    "incremental_airports": incremental_airports,
    "incremental_delays": incremental_delays,
    "explore_clustered": explore_clustered,
    "distinct_by_quarter": distinct_by_quarter,
    "quarantine_counts": quarantine_counts,
    "poll_report": poll_report,
    "unanswered_calls": unanswered_calls,
    "unanswered_calls_stream": unanswered_calls_stream,
    "landed_aircraft_dim": landed_aircraft_dim,
    "explore_days": explore_days,
    "constraint_audit": constraint_audit,
    "ingest_airports": ingest_airports,
    "ingest_airports_csv": ingest_airports_csv,
    "landed_star_delayed_pct": landed_star_delayed_pct,
    "airport_delays_published": airport_delays_published,
    "poll_requests": poll_requests,
    "missing_windows": missing_windows,
    "events_12h_windows": events_12h_windows,
    "events_12h_windows_stream": events_12h_windows_stream,
    "late_events": late_events,
    "stream_dedup_flights": stream_dedup_flights,
    "reconcile_dedup_flights": reconcile_dedup_flights,
}


#: Publishing and ingest runs that queries read from, each made once per application.
PREPARED: dict[str, Callable[[SparkSession, str], object]] = {
    "merge_landings": merged_star, "publish_delays": _published_delays, "land_polls": _polled,
    "dedup_ingest": dedup_run}


def queries() -> dict[str, Query]:
    out = {name: _on_star(fn) for name, fn in STAR_QUERIES.items()}
    out.update(FILE_QUERIES)
    return out
