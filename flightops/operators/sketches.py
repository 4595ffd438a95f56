"""Distinct counts per day that merge (H-1..H-4, M-1 over a range of days).

A distinct count can't be added up over days, a HyperLogLog sketch can be united. One row a day
holds the day's flights and a sketch each of its airlines, registrations and models (some 2 KB at
``LG_K`` 12, whatever the day's rows). A range of days then reads those rows alone; the estimate's
relative standard error is 1.04 / sqrt(2^LG_K), 1.6 %, and small counts are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops import schemas

LG_K = 12
#: Relative standard error of an estimate.
ERROR = 1.04 / math.sqrt(2 ** LG_K)
#: Sketched columns and the measures they give.
MEASURES = {"airline_name": "n_airlines", "aircraft_reg": "n_aircraft", "aircraft_model": "n_models"}


def _known(column: str) -> Column:
    """The value, where it counts: a blank registration is none."""
    return F.when(F.col(column) != "", F.col(column)) if column == "aircraft_reg" else F.col(column)


def daily_sketches(flights: DataFrame) -> DataFrame:
    """One row per UTC day of departure (NULL is a day of its own)."""
    return flights.groupBy(schemas.FLIGHT_DATE).agg(
        F.count(F.lit(1)).alias("n_flights"),
        *[F.hll_sketch_agg(_known(c), F.lit(LG_K)).alias(f"{n}_hll") for c, n in MEASURES.items()])


def united(sketches: DataFrame, *by: Column) -> DataFrame:
    """Flights and estimated distinct counts over all rows, or by groups of days."""
    return sketches.groupBy(*by).agg(
        F.sum("n_flights").cast("long").alias("n_flights"),
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{n}_hll")).alias(n) for n in MEASURES.values()])


def distinct_between(sketches: DataFrame, since: str, until: str) -> DataFrame:
    """One row: flights and estimated distinct counts of the days in [since, until]."""
    day = F.col(schemas.FLIGHT_DATE)
    kept = sketches.where(day.between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    if schemas.FLIGHT_MONTH in sketches.columns:
        kept = kept.where(F.col(schemas.FLIGHT_MONTH).between(since[:7], until[:7]))
    return united(kept)


def exact_counts(flights: DataFrame, *by: Column) -> DataFrame:
    """The same measures counted exactly."""
    return flights.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_flights"), *[F.count_distinct(_known(c)).alias(n) for c, n in MEASURES.items()])
