"""A-8: the aircraft dimension, first-seen row per registration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops import schemas
from flightops.functions import expressions as X


def aircraft_dimension(flights: DataFrame, seen_order: str = schemas.SEEN_ORDER) -> DataFrame:
    """One row per non-blank registration: model and airline of the row seen first.

    ``seen_order`` is a sortable column (a struct compares field by field) giving the
    order in which the rows were collected. ``min`` is an ordinary aggregate with a
    map-side partial step, so a registration on a third of all rows still leaves each
    map task with one candidate per registration; no global row_number, no single task.
    NULL and empty registrations are skipped, as in the reference. Flights without an order
    are refused: the first row would be any.
    """
    if dict(flights.dtypes).get(seen_order) in (None, "void"):
        raise ValueError(f"flights need the order they were seen in ({seen_order})")
    reg = F.col("aircraft_reg")
    values = F.struct("aircraft_model", "airline_name")
    # two answers to one request hold the same places: the values then decide, not the files
    first = F.min(F.struct(F.col(seen_order), values.alias("values")))["values"]
    picked = (
        flights.where(reg.isNotNull() & (reg != ""))
        .groupBy("aircraft_reg")
        .agg(first.alias("first"))
    )
    return picked.select(
        "aircraft_reg",
        F.col("first.aircraft_model").alias("aircraft_model"),
        X.manufacturer(F.col("first.aircraft_model")).alias("manufacturer"),
        F.col("first.airline_name").alias("airline_name"),
    )
