"""Ingest of landed JSON and CSV (S-1 .. S-5).

Landing contract. The poller (not part of this package) writes one JSON line per request
of the flight service, the service's answer plus the request it answers:

    {"poll": "2025-11-22", "airport": "IXM", "window_idx": 0, "window_from": "...",
     "window_to": "...", "answered_at": "...", "departures": [flight, ...], "arrivals": [flight, ...]}

``window_idx`` is the position of the window in the poll order. ``poll`` (a text that ascends
with the polls, such as the day) and ``answered_at`` may be missing; ``journal`` finds the poll
of an answer by its time. Either array may be null
or missing. Airport documents land one per line as the service returns them. Files may be
JSON Lines (splittable, the default) or one whole document per file (``multi_line``).

Schemas are always given (never inferred); malformed lines are kept in
``_corrupt_record`` (PERMISSIVE) and counted by ``landing_report`` instead of aborting the
load as the reference does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightops import schemas
from flightops.functions import expressions as X

CORRUPT = "_corrupt_record"

# The airports the reference polls, in its poll order.
POLLED_AIRPORTS = ["IXM", "COK", "AMD", "JAI", "DEL", "BOM", "BLR", "HYD", "MAA", "PNQ", "DXB", "LHR"]

LANDED_ENVELOPE = T.StructType(
    [T.StructField("airport", T.StringType(), True),
     T.StructField("window_idx", T.IntegerType(), True),
     T.StructField("window_from", T.StringType(), True),
     T.StructField("window_to", T.StringType(), True),
     T.StructField("poll", T.StringType(), True),
     T.StructField("answered_at", T.StringType(), True)]
    + list(schemas.ENVELOPE.fields)
    + [T.StructField(CORRUPT, T.StringType(), True)])

DIRECTION_DEPARTURE, DIRECTION_ARRIVAL = 0, 1


def _reader(spark: SparkSession, schema: T.StructType, multi_line: bool):
    return (spark.read.schema(schema)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("multiLine", multi_line))


# ------------------------------------------------------------------------- S-1, S-5

def read_airport_docs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    schema = T.StructType(list(schemas.AIRPORT_DOC.fields)
                          + [T.StructField(CORRUPT, T.StringType(), True)])
    return _reader(spark, schema, multi_line).json(path)


def airports_from_docs(docs: DataFrame) -> DataFrame:
    """S-1: airport documents -> the ``airports`` dimension (9 columns).

    name = shortName unless empty, else fullName. A missing country/continent/location
    gives NULL (the reference aborts). Malformed lines and documents without a code give no
    airport (the reference skips failed fetches); of documents that repeat a code one stays
    (the greatest, so that reruns agree), else every join to airports would fan out."""
    if CORRUPT in docs.columns:
        docs = docs.where(F.col(CORRUPT).isNull())
    docs = docs.where(F.coalesce("iata", "icao").isNotNull())
    whole = F.struct(*[F.col(c) for c in schemas.AIRPORT_DOC.fieldNames()])
    docs = (docs.groupBy(F.coalesce("iata", "icao").alias("_code")).agg(F.max(whole).alias("_doc"))
            .select("_doc.*"))
    return docs.select(
        F.col("icao").alias("icao_code"),
        F.col("iata").alias("iata_code"),
        X.first_nonblank("shortName", "fullName").alias("name"),
        F.col("municipalityName").alias("city"),
        F.col("country.name").alias("country"),
        F.col("continent.name").alias("continent"),
        F.col("location.lat").alias("latitude"),
        F.col("location.lon").alias("longitude"),
        F.col("timeZone").alias("timezone"),
    )


def read_airports_csv(spark: SparkSession, path: str) -> DataFrame:
    """S-5: the saved airports CSV (header row). Only an empty field is NULL; texts such
    as ``NA`` stay text (pandas would turn them into NULL)."""
    return (spark.read.schema(schemas.AIRPORTS_CSV)
            .option("header", True)
            .option("nullValue", "")
            .option("mode", "PERMISSIVE")
            .csv(path))


# ------------------------------------------------------------------------- S-2, S-4

def read_envelopes(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed envelopes (S-2 input); one row per request answer."""
    return _reader(spark, LANDED_ENVELOPE, multi_line).json(path)


def read_flight_list(spark: SparkSession, path: str) -> DataFrame:
    """S-4: a saved whole-file JSON array of flight documents (the accumulated list)."""
    schema = T.StructType(list(schemas.FLIGHT_DOC.fields)
                          + [T.StructField(CORRUPT, T.StringType(), True)])
    return _reader(spark, schema, True).json(path)


def flights_from_list(docs: DataFrame) -> DataFrame:
    """S-4: a saved list -> the flights fact; the place in the list is the first-seen order.
    ``docs`` from ``read_flight_list`` (one task a file) or ``lists.read_flight_list_split``."""
    place = F.col("place") if "place" in docs.columns else F.struct(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"))
    ordered = docs.where(F.col(CORRUPT).isNull()).select(
        place.alias(schemas.SEEN_ORDER),
        F.struct(*[F.col(c) for c in schemas.FLIGHT_DOC.fieldNames()]).alias("f"))
    return flights_from_docs(ordered, "f", F.col(schemas.SEEN_ORDER))


def _endpoint(doc: Column, side: str) -> tuple[Column, Column, Column, Column]:
    e = doc[side]
    return e["airport"]["iata"], e["airport"]["icao"], e["scheduledTime"]["utc"], e["revisedTime"]["utc"]


def derived_columns() -> dict[str, Column]:
    """The columns of a flight that follow from its others."""
    return {"flight_number": X.flight_number("flight_id"),
            "delay_arr": X.delay_minutes("actual_arr", "scheduled_arr"),
            "delay_dep": X.delay_minutes("actual_dep", "scheduled_dep"),
            "is_canceled": X.in_flag("status", X.CANCELED_STATUSES).cast("int"),
            schemas.FLIGHT_DATE: F.to_date("scheduled_dep")}


def flights_from_docs(docs: DataFrame, doc: str = "f",
                      seen_order: Column | None = None) -> DataFrame:
    """Flight documents (a struct column ``doc``) -> the flights fact.

    Narrow transformation: no shuffle. Delays are recomputed from the parsed times."""
    f = F.col(doc)
    o_iata, o_icao, s_dep, r_dep = _endpoint(f, "departure")
    d_iata, d_icao, s_arr, r_arr = _endpoint(f, "arrival")
    timed = docs.select(
        (seen_order if seen_order is not None else F.lit(None)).alias(schemas.SEEN_ORDER),
        f.alias("_f"),
        X.parse_utc_time(s_dep).alias("scheduled_dep"),
        X.parse_utc_time(r_dep).alias("actual_dep"),
        X.parse_utc_time(s_arr).alias("scheduled_arr"),
        X.parse_utc_time(r_arr).alias("actual_arr"),
        o_iata.alias("origin_iata"), o_icao.alias("origin_icao"),
        d_iata.alias("dest_iata"), d_icao.alias("dest_icao"),
    )
    g = F.col("_f")
    status = g["status"]
    out = timed.select(
        schemas.SEEN_ORDER,
        g["number"].alias("flight_id"),
        X.flight_number(g["number"]).alias("flight_number"),
        g["airline"]["iata"].alias("airline_code"),
        g["airline"]["name"].alias("airline_name"),
        g["aircraft"]["reg"].alias("aircraft_reg"),
        g["aircraft"]["model"].alias("aircraft_model"),
        "origin_iata", "origin_icao", "dest_iata", "dest_icao",
        "scheduled_arr", "actual_arr",
        X.delay_minutes("actual_arr", "scheduled_arr").alias("delay_arr"),
        "scheduled_dep", "actual_dep",
        X.delay_minutes("actual_dep", "scheduled_dep").alias("delay_dep"),
        status.alias("status"),
        X.flag_int(g["isCargo"]).alias("is_cargo"),
        X.in_flag(status, X.CANCELED_STATUSES).cast("int").alias("is_canceled"),
    )
    return out.withColumn(schemas.FLIGHT_DATE, F.to_date("scheduled_dep"))


def explode_envelopes(envelopes: DataFrame, polled: list[str] | None = None) -> DataFrame:
    """One row per flight document with its first-seen order (poll, position of the airport in
    it, window, start of the window, departures before arrivals, array position). The poll
    comes first, as all of an earlier poll was seen before any of a later one; answers without a
    poll precede those with one. Null or missing arrays give no rows."""
    polled = polled or POLLED_AIRPORTS
    legs = F.array(
        F.struct(F.lit(DIRECTION_DEPARTURE).alias("dir"), F.col("departures").alias("items")),
        F.struct(F.lit(DIRECTION_ARRIVAL).alias("dir"), F.col("arrivals").alias("items")))
    if "poll" not in envelopes.columns:
        envelopes = envelopes.withColumn("poll", F.lit(None).cast("string"))
    request = ["poll", "airport", "window_idx", "window_from"]
    per_leg = envelopes.select(*request, F.inline(legs))
    docs = per_leg.select(*request, "dir", F.posexplode("items").alias("pos", "f"))
    position = F.array_position(F.array(*[F.lit(a) for a in polled]), F.col("airport"))
    # airports outside the poll list come after all polled ones
    airport_pos = F.when(position > 0, position).otherwise(F.lit(len(polled) + 1))
    order = F.struct(F.col("poll"), airport_pos.alias("airport_pos"), F.col("airport"),
                     F.col("window_idx"), F.col("window_from"), F.col("dir"), F.col("pos"))
    return docs.withColumn(schemas.SEEN_ORDER, order)


def flights_from_envelopes(envelopes: DataFrame, polled: list[str] | None = None) -> DataFrame:
    """S-2: landed envelopes -> the flights fact (19 columns + seen_order + flight_date)."""
    docs = explode_envelopes(envelopes, polled)
    return flights_from_docs(docs, "f", F.col(schemas.SEEN_ORDER))


# ------------------------------------------------------------------------- S-3

def answered() -> Column:
    """Whether a landed line is an answer: its request can be read. A line with a field of
    the wrong type is one (its other fields load); a broken line is not."""
    return F.col(CORRUPT).isNull() | F.col("airport").isNotNull()


def answered_requests(envelopes: DataFrame) -> DataFrame:
    """The distinct requests (airport, window_from) that were answered."""
    return envelopes.where(answered()).select("airport", "window_from").distinct()


def landing_report(envelopes: DataFrame) -> DataFrame:
    """S-3: per (airport, window) the requests answered, departures, arrivals and
    malformed lines. A window is its start; its number begins anew with each poll. Calls,
    errors and retries of each poll: ``journal.poll_report``.
    ``landing_rejects`` counts what did not load, by reason."""
    return (envelopes.groupBy("airport", "window_idx", "window_from")
            .agg(F.count_if(answered()).alias("answers"),
                 F.count_if(~answered()).alias("malformed"),
                 F.sum(F.coalesce(F.size("departures"), F.lit(0))).cast("long").alias("departures"),
                 F.sum(F.coalesce(F.size("arrivals"), F.lit(0))).cast("long").alias("arrivals")))


def _bad_time(doc: Column) -> Column:
    """Whether any time text of a flight document can't be parsed."""
    bad = F.lit(False)
    for side in ("departure", "arrival"):
        for kind in ("scheduledTime", "revisedTime"):
            text = doc[side][kind]["utc"]
            bad = bad | (text.isNotNull() & X.parse_utc_time(text).isNull())
    return bad


def landing_rejects(envelopes: DataFrame) -> DataFrame:
    """S-3 by reason, per airport (NULL: lines whose airport can't be read): lines, broken
    lines, answers with a field of the wrong type, without a full window, or with neither
    array, flights, and
    flights with an unreadable time, without a number, without an aircraft or without an
    airline block. A line counts in each reason it meets.

    The counts are made inside each line (an array of a few hundred flights at most), so
    nothing is exploded and one map-side combined aggregation by airport remains."""
    flights = F.concat(*[F.coalesce(F.col(c), F.array()) for c in ("departures", "arrivals")])
    e = envelopes.withColumn("_flights", flights)

    def among(test) -> Column:
        return F.sum(F.size(F.filter("_flights", test)).cast("long"))

    return e.groupBy("airport").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~answered()).alias("broken_lines"),
        F.count_if(answered() & F.col(CORRUPT).isNotNull()).alias("wrong_typed"),
        # a reader parses only columns in use: this count keeps the request's fields in use, so
        # that a wrong type there shows in the count above
        F.count_if(answered() & (F.col("window_idx").isNull() | F.col("window_from").isNull()
                                 | F.col("window_to").isNull())).alias("no_window"),
        F.count_if(answered() & F.col("departures").isNull() & F.col("arrivals").isNull()).alias("without_flights"),
        F.sum(F.size("_flights").cast("long")).alias("flights"),
        among(_bad_time).alias("bad_times"),
        among(lambda f: f["number"].isNull()).alias("no_number"),
        among(lambda f: f["aircraft"].isNull()).alias("no_aircraft"),
        among(lambda f: f["airline"].isNull()).alias("no_airline"))


def landing_totals(envelopes: DataFrame) -> DataFrame:
    """S-3 per airport: requests answered, malformed lines and flights received (departures
    plus arrivals), the reference's per-airport totals and call/error counters."""
    report = landing_report(envelopes)
    return (report.groupBy("airport")
            .agg(F.sum("answers").cast("long").alias("answers"),
                 F.sum("malformed").cast("long").alias("malformed"),
                 (F.sum("departures") + F.sum("arrivals")).cast("long").alias("flights")))
