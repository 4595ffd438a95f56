"""Dashboard queries: KPIs (H), explorer (X), fleet (M), airport lookup (L), delays (D).

The reference runs these from a dashboard and pulls whole results into the client;
here each is a DataFrame and only its (bounded) result leaves the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops import schemas
from flightops.functions import expressions as X


def _asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def _desc(name: str) -> Column:
    return F.col(name).desc_nulls_last()


# ------------------------------------------------------------------------- H

def kpis(flights: DataFrame, aircraft: DataFrame, airports: DataFrame,
         approx_airlines: bool = False) -> DataFrame:
    """H-1..H-4 in one row: flights, aircraft, airports, distinct airline names.

    One scan of the fact for both of its numbers; the dimension counts are scalar
    subqueries (no cross join). ``approx_airlines`` counts airlines with HyperLogLog
    (one pass, no shuffle of airline names; about 2% error)."""
    if approx_airlines:
        totals = flights.agg(F.count(F.lit(1)).alias("total_flights"),
                             F.approx_count_distinct("airline_name").alias("total_airlines"))
    else:
        # two plain aggregations instead of a distinct aggregate (no Expand of the fact):
        # rows per airline first, then the non-NULL airline groups are the distinct count
        per_airline = flights.groupBy("airline_name").agg(F.count(F.lit(1)).alias("n"))
        totals = per_airline.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_flights"),
                                 F.count("airline_name").alias("total_airlines"))
    return totals.select(
        "total_flights",
        aircraft.agg(F.count(F.lit(1))).scalar().alias("total_aircraft"),
        airports.agg(F.count(F.lit(1))).scalar().alias("total_airports"),
        "total_airlines",
    )


def status_distribution(flights: DataFrame) -> DataFrame:
    """H-5: flights per status (NULL is a group)."""
    return (flights.groupBy("status").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(_desc("count"), _asc("status")))


def top_airlines(flights: DataFrame, k: int = 5) -> DataFrame:
    """H-6: the ``k`` airlines with most flights; tie-break airline_name (NULLs last)."""
    return (flights.groupBy("airline_name").agg(F.count(F.lit(1)).alias("flight_count"))
            .orderBy(_desc("flight_count"), _asc("airline_name")).limit(k))


# ------------------------------------------------------------------------- X

def facet_airlines(flights: DataFrame) -> DataFrame:
    """X-1: distinct airline names, sorted (NULL included, first as in the reference)."""
    return flights.select("airline_name").distinct().orderBy(F.col("airline_name").asc_nulls_first())


def facet_statuses(flights: DataFrame) -> DataFrame:
    """X-2: distinct statuses, sorted."""
    return flights.select("status").distinct().orderBy(F.col("status").asc_nulls_first())


def facet_airports(airports: DataFrame) -> DataFrame:
    """X-3: distinct airport IATA codes, sorted."""
    return airports.select("iata_code").distinct().orderBy(F.col("iata_code").asc_nulls_first())


EXPLORE_COLUMNS = ["flight_number", "airline_name", "origin", "origin_city",
                   "scheduled_dep", "status"]


def flights_between(flights: DataFrame, since: str, until: str) -> DataFrame:
    """Flights whose UTC day of departure lies in [since, until]. On a fact partitioned by
    day or by month the bounds are partition filters, so other folders are not read."""
    day = F.col(schemas.FLIGHT_DATE)
    kept = flights.where(day.between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    if schemas.FLIGHT_MONTH in flights.columns:
        kept = kept.where(F.col(schemas.FLIGHT_MONTH).between(since[:7], until[:7]))
    return kept


def explore_base(flights: DataFrame, airports: DataFrame, airline: str | None = None,
                 origin: str | None = None) -> DataFrame:
    """X-4: flights joined to their origin airport, optionally one airline and/or one
    origin IATA code. ``None`` is the reference's "All". No status predicate here, so the
    metrics stay the same whatever status the table view selects.

    The airline predicate reaches the Parquet scan of the fact; the origin predicate the
    scan of the (broadcast) airports."""
    f = flights
    if airline is not None:
        f = f.where(F.col("airline_name") == airline)
    o = airports.select(F.col("icao_code").alias("o_icao"), F.col("iata_code").alias("origin"),
                        F.col("city").alias("origin_city"))
    if origin is not None:
        o = o.where(F.col("origin") == origin)
    return (f.join(o, f["origin_icao"] == o["o_icao"])
            .select("flight_number", "airline_name", "origin", "origin_city",
                    "scheduled_dep", "status"))


def explore_table(flights: DataFrame, airports: DataFrame, airline: str | None = None,
                  status: str | None = None, origin: str | None = None,
                  limit: int = 1000) -> DataFrame:
    """X-5: the explorer's table: X-4, optional status, latest scheduled departure first,
    at most ``limit`` rows. Tie-break: the other output columns ascending, NULLs last."""
    base = explore_base(flights, airports, airline, origin)
    if status is not None:
        base = base.where(F.col("status") == status)
    order = [_desc("scheduled_dep")] + [_asc(c) for c in EXPLORE_COLUMNS if c != "scheduled_dep"]
    return base.orderBy(*order).limit(limit)


def explore_metrics(flights: DataFrame, airports: DataFrame, airline: str | None = None,
                    origin: str | None = None) -> DataFrame:
    """X-6: total, cancelled ('Canceled' only) and cancelled percent over X-4; zeros when
    nothing matches. One aggregate in the cluster instead of pulling the set."""
    base = explore_base(flights, airports, airline, origin)
    agg = base.agg(F.count(F.lit(1)).alias("total_flights"),
                   F.count_if(F.col("status") == "Canceled").alias("canceled_flights"))
    return agg.select(
        "total_flights", "canceled_flights",
        F.coalesce(X.pct("canceled_flights", "total_flights"), F.lit(0.0)).alias("canceled_pct"))


@dataclass
class Exploration:
    table: DataFrame      # X-5: at most ``limit`` rows, latest departure first
    metrics: DataFrame    # X-6: one row, over all statuses


def explore(flights: DataFrame, airports: DataFrame, airline: str | None = None,
            status: str | None = None, origin: str | None = None,
            limit: int = 1000) -> Exploration:
    """The explorer in one call: both views share the lazy X-4 base; ``None`` is "All".
    The status choice narrows the table only, never the metrics."""
    return Exploration(explore_table(flights, airports, airline, status, origin, limit),
                       explore_metrics(flights, airports, airline, origin))


# ------------------------------------------------------------------------- M

def fleet_models(flights: DataFrame, aircraft: DataFrame, k: int = 10) -> DataFrame:
    """M-1: top ``k`` (model, manufacturer) by flights, with distinct airlines using them.

    The fact is reduced to (registration, airline) first; a distinct count of airlines
    over those rows equals the one over the flights. Tie-break: model, manufacturer."""
    per_reg = (flights.where(F.col("aircraft_reg").isNotNull())
               .groupBy("aircraft_reg", "airline_name")
               .agg(F.count("flight_id").alias("n")))
    # (model, manufacturer, airline) groups, then the non-NULL airline groups per model are
    # its distinct airlines: two plain aggregations, no Expand
    per_airline = (per_reg.join(aircraft.select("aircraft_reg", "aircraft_model", "manufacturer"),
                                "aircraft_reg")
                   .groupBy("aircraft_model", "manufacturer", "airline_name")
                   .agg(F.sum("n").alias("n")))
    return (per_airline.groupBy("aircraft_model", "manufacturer")
            .agg(F.sum("n").cast("long").alias("flight_count"),
                 F.count("airline_name").alias("airlines_using"))
            .orderBy(_desc("flight_count"), _asc("aircraft_model"), _asc("manufacturer"))
            .limit(k))


def manufacturers(aircraft: DataFrame) -> DataFrame:
    """M-2: aircraft per manufacturer (NULL is a group)."""
    return (aircraft.groupBy("manufacturer").agg(F.count(F.lit(1)).alias("aircraft_count"))
            .orderBy(_desc("aircraft_count"), _asc("manufacturer")))


# ------------------------------------------------------------------------- L

def airport_list(airports: DataFrame) -> DataFrame:
    """L-1: airports by name."""
    return airports.select("iata_code", "name", "city").orderBy(_asc("name"), _asc("iata_code"))


def airport_detail(airports: DataFrame, iata: str) -> DataFrame:
    """L-2: the full row(s) of one airport code."""
    return airports.where(F.col("iata_code") == iata)


# ------------------------------------------------------------------------- D

def delay_overview(flights: DataFrame) -> DataFrame:
    """D-1: flights, departures delayed (> 0 min), average positive delay, max delay."""
    dep = F.col("delay_dep")
    return flights.agg(
        F.count(F.lit(1)).alias("total_flights"),
        X.sum_flag(dep > 0).alias("delayed_flights"),
        X.round_half_up(F.avg(F.when(dep > 0, dep)), 2).alias("avg_delay"),
        F.max(dep).alias("max_delay"),
    )


def delays_by_airport(flights: DataFrame, airports: DataFrame, min_flights: int = 10) -> DataFrame:
    """D-2: departure delays per origin airport (grouped by name and IATA code) with more
    than ``min_flights`` flights, highest delayed percent first.

    Partial sums per origin code first; the average is their ratio."""
    dep = F.col("delay_dep")
    positive = F.when(dep > 0, dep)
    partial = (flights.where(F.col("origin_icao").isNotNull())
               .groupBy("origin_icao")
               .agg(F.count("flight_id").alias("n"), X.sum_flag(dep > 0).alias("d"),
                    F.sum(positive).alias("s"), F.count(positive).alias("c")))
    joined = partial.join(airports, partial["origin_icao"] == airports["icao_code"])
    per_airport = joined.groupBy("name", "iata_code").agg(
        F.sum("n").cast("long").alias("total_flights"),
        F.sum("d").cast("long").alias("delayed_flights"),
        F.sum("s").alias("s"), F.sum("c").alias("c"))
    return (per_airport.where(F.col("total_flights") > min_flights)
            .select(F.col("name").alias("airport_name"), "iata_code", "total_flights",
                    "delayed_flights",
                    X.round_half_up(F.try_divide(F.col("s"), F.col("c")), 2).alias("avg_delay"),
                    X.pct_round("delayed_flights", "total_flights").alias("delay_percentage"))
            .orderBy(_desc("delay_percentage"), _asc("iata_code")))
