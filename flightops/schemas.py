"""Fixed schemas: landed documents and the published star schema.

JSON is never schema-inferred: an all-null struct field would come back as ``string``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# ---------------------------------------------------------------- landed documents

AIRPORT_DOC = _struct(
    ("icao", S),
    ("iata", S),
    ("shortName", S),
    ("fullName", S),
    ("municipalityName", S),
    ("country", _struct(("name", S))),
    ("continent", _struct(("name", S))),
    ("location", _struct(("lat", D), ("lon", D))),
    ("timeZone", S),
)

_TIME = _struct(("utc", S))
_ENDPOINT = _struct(
    ("airport", _struct(("iata", S), ("icao", S))),
    ("scheduledTime", _TIME),
    ("revisedTime", _TIME),
)

FLIGHT_DOC = _struct(
    ("number", S),
    ("status", S),
    ("isCargo", T.BooleanType()),
    ("aircraft", _struct(("reg", S), ("model", S), ("modeS", S))),
    ("airline", _struct(("iata", S), ("name", S), ("icao", S))),
    ("departure", _ENDPOINT),
    ("arrival", _ENDPOINT),
)

# One answer of the flight service per (airport, 12-hour window).
ENVELOPE = _struct(
    ("departures", T.ArrayType(FLIGHT_DOC, True)),
    ("arrivals", T.ArrayType(FLIGHT_DOC, True)),
)

# ---------------------------------------------------------------- published tables

AIRPORTS = _struct(
    ("icao_code", S),
    ("iata_code", S),
    ("name", S),
    ("city", S),
    ("country", S),
    ("continent", S),
    ("latitude", D),
    ("longitude", D),
    ("timezone", S),
)

# The 19 columns of the flights fact, in the reference's order.
FLIGHT_COLUMNS = [
    "flight_id", "flight_number", "airline_code", "airline_name",
    "aircraft_reg", "aircraft_model",
    "origin_iata", "origin_icao", "dest_iata", "dest_icao",
    "scheduled_arr", "actual_arr", "delay_arr", "scheduled_dep", "actual_dep", "delay_dep",
    "status", "is_cargo", "is_canceled",
]

AIRCRAFT_COLUMNS = ["aircraft_reg", "aircraft_model", "manufacturer", "airline_name"]

AIRPORT_COLUMNS = [f.name for f in AIRPORTS.fields]

# Columns that carry the first-seen order of a flight row (used by the aircraft
# dimension) and the publish partition column. Not part of the 19 reported columns.
SEEN_ORDER = "seen_order"
FLIGHT_DATE = "flight_date"
FLIGHT_MONTH = "flight_month"   # yyyy-MM, where a fact is partitioned by month

# airport_delays: the daily rollup the reference declares but never fills.
AIRPORT_DELAYS = _struct(
    ("airport_iata", S),
    ("delay_date", T.DateType()),
    ("total_flights", T.LongType()),
    ("delayed_flights", T.LongType()),
    ("avg_delay_min", D),
    ("median_delay_min", D),
    ("canceled_flights", T.LongType()),
)

# CSV copy of the airports dimension (all text or numbers, header row).
AIRPORTS_CSV = AIRPORTS
