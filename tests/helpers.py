"""Hand-made star tables for unit tests."""

import datetime as dt

from pyspark.sql import types as T

from flightops import schemas

FLIGHTS_SCHEMA = T.StructType([
    T.StructField(schemas.SEEN_ORDER, T.StructType([T.StructField("seq", T.IntegerType())])),
    *[T.StructField(c, t) for c, t in [
        ("flight_id", T.StringType()), ("flight_number", T.StringType()),
        ("airline_code", T.StringType()), ("airline_name", T.StringType()),
        ("aircraft_reg", T.StringType()), ("aircraft_model", T.StringType()),
        ("origin_iata", T.StringType()), ("origin_icao", T.StringType()),
        ("dest_iata", T.StringType()), ("dest_icao", T.StringType()),
        ("scheduled_arr", T.TimestampNTZType()), ("actual_arr", T.TimestampNTZType()),
        ("delay_arr", T.DoubleType()), ("scheduled_dep", T.TimestampNTZType()),
        ("actual_dep", T.TimestampNTZType()), ("delay_dep", T.DoubleType()),
        ("status", T.StringType()), ("is_cargo", T.IntegerType()), ("is_canceled", T.IntegerType())]],
])

AIRPORT_ROWS = [
    # icao, iata, name, city, country
    ("VIDP", "DEL", "Delhi", "New Delhi", "India"),
    ("VABB", "BOM", "Mumbai", "Mumbai", "India"),
    ("OMDB", "DXB", "Dubai", "Dubai", "United Arab Emirates"),
    ("EGLL", "LHR", "Heathrow", "London", "United Kingdom"),
    ("VOMM", "MAA", "Chennai", "Chennai", None),
]

T0 = dt.datetime(2025, 11, 20, 6, 0)


def airports(spark):
    rows = [(icao, iata, name, city, country, None, 0.0, 0.0, "UTC")
            for icao, iata, name, city, country in AIRPORT_ROWS]
    return spark.createDataFrame(rows, schemas.AIRPORTS)


def flights(spark, rows):
    """rows: dicts with any of the flight columns; ``seq`` sets the first-seen order."""
    names = [f.name for f in FLIGHTS_SCHEMA.fields]
    out = []
    for i, r in enumerate(rows):
        r = dict(r)
        seq = r.pop("seq", i)
        r.setdefault("flight_id", f"XX {i}")
        r.setdefault("flight_number", r["flight_id"].split(" ")[-1] if r["flight_id"] else "")
        r.setdefault("is_cargo", 0)
        r.setdefault("is_canceled", 1 if r.get("status") in ("Canceled", "CanceledUncertain") else 0)
        out.append(tuple([(seq,)] + [r.get(n) for n in names[1:]]))
    return spark.createDataFrame(out, FLIGHTS_SCHEMA)
