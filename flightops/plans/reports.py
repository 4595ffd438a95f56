"""The eleven report queries (Q-1 .. Q-11, plus Q-5b).

Plans, not SQL text. Where the reference joins the fact to a dimension and then groups
by dimension columns, the fact is first reduced by its join key (a hash aggregate with a
map-side partial step) and only the reduced rows meet the dimension. That is exact
because dimension keys are unique (the constraint audit checks it); airports are
re-grouped after the join anyway, which costs nothing on a dozen rows and keeps the
literal result even for a duplicated airport row.

Literal defaults are the reference's; LIMIT queries get a documented total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.functions import expressions as X


def _asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def _desc(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def _counts_by(flights: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """Fact reduced to one row per non-null ``key`` value."""
    return (flights.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(*[expr.alias(name) for name, expr in aggs.items()]))


def _airport_counts(flights: DataFrame, airports: DataFrame, key: str,
                    group_cols: list[str], **aggs: Column) -> DataFrame:
    """Per-airport sums of the per-key partial counts; inner join on icao_code."""
    partial = _counts_by(flights, key, **aggs)
    joined = partial.join(airports, partial[key] == airports["icao_code"])
    return joined.groupBy(*group_cols).agg(
        *[F.sum(name).cast("long").alias(name) for name in aggs])


# ------------------------------------------------------------------------- Q-1 .. Q-4

def flights_per_model(flights: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Q-1: flights per aircraft model (COUNT of non-null flight ids), count desc."""
    per_reg = _counts_by(flights, "aircraft_reg", n=F.count("flight_id"))
    return (per_reg.join(aircraft.select("aircraft_reg", "aircraft_model"), "aircraft_reg")
            .groupBy("aircraft_model")
            .agg(F.sum("n").cast("long").alias("total_flights"))
            .orderBy(_desc("total_flights"), _asc("aircraft_model")))


def busy_aircraft(flights: DataFrame, aircraft: DataFrame, min_flights: int = 5) -> DataFrame:
    """Q-2: aircraft assigned to more than ``min_flights`` flights."""
    per_reg = _counts_by(flights, "aircraft_reg", flight_count=F.count("flight_id"))
    return (per_reg.where(F.col("flight_count") > min_flights)
            .join(aircraft, "aircraft_reg")
            .select(F.col("aircraft_reg").alias("registration"),
                    F.col("aircraft_model").alias("model"),
                    "manufacturer", "flight_count")
            .orderBy(_desc("flight_count"), _asc("registration")))


def outbound_airports(flights: DataFrame, airports: DataFrame, min_flights: int = 5) -> DataFrame:
    """Q-3: airports with more than ``min_flights`` outbound flights."""
    counts = _airport_counts(flights, airports, "origin_icao",
                             ["icao_code", "name", "city", "country"],
                             outbound_flights=F.count("flight_id"))
    return (counts.where(F.col("outbound_flights") > min_flights)
            .select(F.col("name").alias("airport_name"), "city", "country", "outbound_flights")
            .orderBy(_desc("outbound_flights"), _asc("airport_name")))


def top_destinations(flights: DataFrame, airports: DataFrame, k: int = 3) -> DataFrame:
    """Q-4: top ``k`` destination airports by arriving flights.

    Tie-break: name, city, country (ascending, NULLs last)."""
    counts = _airport_counts(flights, airports, "dest_icao",
                             ["icao_code", "name", "city", "country"],
                             arriving_flights=F.count("flight_id"))
    return (counts.select(F.col("name").alias("airport_name"), "city", "country",
                          "arriving_flights")
            .orderBy(_desc("arriving_flights"), _asc("airport_name"), _asc("city"), _asc("country"))
            .limit(k))


# ------------------------------------------------------------------------- Q-5, Q-5b

def _typed_ends(rows: DataFrame, airports: DataFrame) -> DataFrame:
    """Left-join both ends to airports; keep rows with at least one known end."""
    o = airports.select(F.col("icao_code").alias("o_icao"), F.col("iata_code").alias("origin"),
                        F.col("country").alias("origin_country"))
    d = airports.select(F.col("icao_code").alias("d_icao"), F.col("iata_code").alias("destination"),
                        F.col("country").alias("dest_country"))
    return (rows.join(o, rows["origin_icao"] == o["o_icao"], "left")
            .join(d, rows["dest_icao"] == d["d_icao"], "left")
            .where(F.col("o_icao").isNotNull() | F.col("d_icao").isNotNull())
            .withColumn("flight_type", X.flight_type("origin_country", "dest_country")))


FLIGHT_TYPE_COLUMNS = ["flight_number", "origin", "origin_country", "destination",
                       "dest_country", "flight_type"]


def flight_type(flights: DataFrame, airports: DataFrame, limit: int | None = 200) -> DataFrame:
    """Q-5: per flight, both ends and Domestic/International.

    The reference takes an unordered LIMIT; here the order is all output columns
    (ascending, NULLs last), so the chosen rows are deterministic. ``limit=None`` returns
    all rows."""
    typed = _typed_ends(flights.select("flight_number", "origin_icao", "dest_icao"), airports)
    out = typed.select(*FLIGHT_TYPE_COLUMNS)
    if limit is None:
        return out
    return out.orderBy(*[_asc(c) for c in FLIGHT_TYPE_COLUMNS]).limit(limit)


def flight_type_counts(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Q-5b: flights per flight type over all of Q-5's rows.

    The fact is reduced to (origin, destination) pairs first, so the joins and the CASE
    run on at most (#airports + 1)^2 rows."""
    pairs = (flights.groupBy("origin_icao", "dest_icao")
             .agg(F.count(F.lit(1)).alias("n")))
    return (_typed_ends(pairs, airports)
            .groupBy("flight_type")
            .agg(F.sum("n").cast("long").alias("flight_count"))
            .orderBy(_desc("flight_count"), _asc("flight_type")))


# ------------------------------------------------------------------------- Q-6, Q-7

LATEST_ARRIVAL_ORDER = ["scheduled_arr", "flight_number", "aircraft_reg", "origin_icao",
                        "actual_arr", "status"]


def latest_arrivals(flights: DataFrame, aircraft: DataFrame, airports: DataFrame,
                    iata: str = "DEL", k: int = 5) -> DataFrame:
    """Q-6: the ``k`` arrivals at ``iata`` with the latest scheduled arrival, showing the
    revised (actual) arrival time.

    The top ``k`` flights are chosen first (TakeOrderedAndProject keeps k rows per task);
    only those k rows are then enriched. Pass the aircraft dimension broadcast-hinted when
    its size is proven (``Star.aircraft_dim``); otherwise the k rows meet it in a shuffle
    join, which moves the dimension, never the fact. Tie-break after scheduled_arr DESC
    (NULLs last): flight_number, aircraft_reg, origin_icao, actual_arr, status ascending
    (NULLs last); rows tied on all of these give identical output rows.
    """
    dest = airports.where(F.col("iata_code") == iata).select(F.col("icao_code").alias("d_icao"))
    order = [_desc("scheduled_arr")] + [_asc(c) for c in LATEST_ARRIVAL_ORDER[1:]]
    top = (flights.join(dest, flights["dest_icao"] == dest["d_icao"])
           .select(*LATEST_ARRIVAL_ORDER)
           .orderBy(*order).limit(k))
    planes = aircraft.select("aircraft_reg", F.col("aircraft_model").alias("aircraft"),
                             "manufacturer")
    origin = airports.select(F.col("icao_code").alias("o_icao"),
                             F.col("name").alias("departure_airport"),
                             F.col("city").alias("departure_city"))
    return (top.join(planes, "aircraft_reg", "left")
            .join(origin, top["origin_icao"] == origin["o_icao"], "left")
            .orderBy(*order)
            .select("flight_number", "aircraft", "manufacturer", "departure_airport",
                    "departure_city", F.col("actual_arr").alias("arrival_time"), "status"))


def airports_without_arrivals(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Q-7: airports never used as a destination (anti join on the distinct dest codes).

    The distinct destination set is a partial-aggregated scan of one column and tiny, so
    AQE broadcasts it; the fact is never the build side of the anti join.
    """
    dests = (flights.where(F.col("dest_icao").isNotNull())
             .select("dest_icao").distinct())
    return (airports.join(dests, airports["icao_code"] == dests["dest_icao"], "left_anti")
            .select("iata_code", F.col("name").alias("airport_name"), "city", "country")
            .orderBy(_asc("airport_name"), _asc("iata_code")))


# ------------------------------------------------------------------------- Q-8 .. Q-11

# The statuses counted per airline, in the reference's column order.
STATUS_COUNT_COLUMNS = [
    ("arrived", "Arrived"),
    ("departed", "Departed"),
    ("unknown", "Unknown"),
    ("expected", "Expected"),
    ("approaching", "Approaching"),
    ("canceled", "Canceled"),
    ("delayed", "Delayed"),
]


def status_by_airline(flights: DataFrame) -> DataFrame:
    """Q-8: per airline (NULL is a group), the seven status counts and the total of
    non-null flight ids. Other statuses only count in the total."""
    status = F.col("status")
    aggs = [X.sum_flag(status == value).alias(name) for name, value in STATUS_COUNT_COLUMNS]
    return (flights.groupBy("airline_name")
            .agg(*aggs, F.count("flight_id").alias("total_flights"))
            .orderBy(_desc("total_flights"), _asc("airline_name")))


def cancelled_flights(flights: DataFrame, airports: DataFrame,
                      status: str = "Canceled", ordered: bool = True) -> DataFrame:
    """Q-9: cancelled flights with their destination, latest scheduled departure first.

    Only the destination is joined: the reference's aircraft and origin joins add no
    column and, dimension keys being unique, no row."""
    dest = airports.select(F.col("icao_code").alias("d_icao"),
                           F.col("name").alias("destination_airport"),
                           F.col("city").alias("destination_city"))
    cancelled = flights.where(F.col("status") == status)
    out = (cancelled.join(dest, cancelled["dest_icao"] == dest["d_icao"], "left")
           .select("flight_number", "airline_name", "destination_airport", "destination_city",
                   F.col("scheduled_dep").alias("scheduled_departure"), "status"))
    # ``ordered=False`` skips the global sort (and its sampling pass over the scan)
    return out.orderBy(_desc("scheduled_departure")) if ordered else out


def city_pair_models(flights: DataFrame, airports: DataFrame, aircraft: DataFrame,
                     min_models: int = 2, k: int | None = 20) -> DataFrame:
    """Q-10: (origin, destination) city pairs served by more than ``min_models``
    distinct aircraft models, with the sorted, comma-joined model list.

    The fact is first reduced to distinct (origin, destination, registration) triples,
    which is all a distinct-model count needs; only those meet the aircraft dimension.
    The per-pair model set is bounded by the number of distinct models.
    Tie-break: origin_code, dest_code, origin_city, dest_city ascending, NULLs last.
    """
    triples = flights.select("origin_icao", "dest_icao", "aircraft_reg").distinct()
    models = aircraft.select("aircraft_reg", "aircraft_model")
    # A triple without a known registration holds no model, so it can't lift a pair above
    # min_models: an inner join, which keeps NULL registrations out of the shuffle too
    if min_models < 0:
        raise ValueError("min_models must be 0 or more")
    triples = triples.join(models, "aircraft_reg")
    o = airports.select(F.col("icao_code").alias("o_icao"), F.col("city").alias("origin_city"),
                        F.col("iata_code").alias("origin_code"))
    d = airports.select(F.col("icao_code").alias("d_icao"), F.col("city").alias("dest_city"),
                        F.col("iata_code").alias("dest_code"))
    enriched = (triples
                .join(o, triples["origin_icao"] == o["o_icao"], "left")
                .join(d, triples["dest_icao"] == d["d_icao"], "left"))
    grouped = (enriched.groupBy("origin_city", "dest_city", "origin_code", "dest_code")
               .agg(F.collect_set("aircraft_model").alias("models"))
               .withColumn("aircraft_model_count", F.size("models").cast("long"))
               .where(F.col("aircraft_model_count") > min_models)
               .select("origin_city", "dest_city", "origin_code", "dest_code",
                       "aircraft_model_count",
                       F.concat_ws(",", F.array_sort("models")).alias("aircraft_models")))
    ordered = grouped.orderBy(_desc("aircraft_model_count"), _asc("origin_code"),
                              _asc("dest_code"), _asc("origin_city"), _asc("dest_city"))
    return ordered.limit(k) if k is not None else ordered


def delayed_pct_by_destination(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Q-11: per destination airport, arrivals, delayed arrivals and delayed percent.

    "Delayed" is the query's own definition: status 'Delayed' OR delay_arr > 0 (NULL on
    both sides counts as not delayed)."""
    delayed = (F.col("status") == "Delayed") | (F.col("delay_arr") > 0)
    counts = _airport_counts(flights, airports, "dest_icao",
                             ["icao_code", "name", "city", "iata_code"],
                             total_arrivals=F.count("flight_id"),
                             delayed_arrivals=X.sum_flag(delayed))
    return (counts.where(F.col("total_arrivals") > 0)
            .select(F.col("name").alias("airport_name"), "city", "iata_code",
                    "total_arrivals", "delayed_arrivals",
                    X.pct_round("delayed_arrivals", "total_arrivals").alias("delay_percentage"))
            .orderBy(_desc("delay_percentage"), _asc("iata_code")))
