"""Scalar column expressions (JVM-side, inside whole-stage codegen; no Python UDF)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# First word of an aircraft model (lower case) -> manufacturer, as the
# reference defines them. Anything else (and blank or missing models) -> NULL.
MANUFACTURER_BY_FIRST_WORD = {
    "airbus": "Airbus",
    "boeing": "Boeing",
    "atr": "ATR",
    "embraer": "Embraer",
    "bombardier": "Bombardier",
    "bae": "BAe",
    "mcdonnell": "McDonnell Douglas",
    "ilyushin": "Ilyushin",
    "cessna": "Cessna",
    "canadair": "Canadair",
    "de": "De Havilland",
}

# Statuses that mark a flight as cancelled in the `is_canceled` flag.
CANCELED_STATUSES = ("Canceled", "CanceledUncertain")

# Fixed value: the text layout of a UTC time once its `Z` is removed, year-month-day
# hour:minute. One-letter fields accept one or two digits, as the reference's parse does.
UTC_TIME_PATTERN = "yyyy-M-d H:m"


# The same layout at full width: what a time looks like but for rare ones, and is read much faster.
FULL_UTC_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}Z?\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_utc_time(text: Column | str) -> Column:
    """F-1: ``'2025-11-20 06:05Z'`` -> TIMESTAMP_NTZ 2025-11-20 06:05.

    Every ``Z`` is removed first (so a time without ``Z`` parses too); blank or
    malformed text gives NULL instead of aborting the load. A text of full width is
    cast; any other, and one that names no time, goes through the pattern.
    """
    text = _col(text)
    cast = F.when(text.rlike(FULL_UTC_TIME), F.substring(text, 1, 16).try_cast("timestamp_ntz"))
    parsed = F.try_to_timestamp(F.translate(text, "Z", ""), F.lit(UTC_TIME_PATTERN))
    return F.coalesce(cast, parsed.cast("timestamp_ntz"))


def delay_minutes(actual: Column | str, scheduled: Column | str) -> Column:
    """F-2: (actual - scheduled) in minutes as a double; NULL if either is missing."""
    return F.timestamp_diff("SECOND", _col(scheduled), _col(actual)) / F.lit(60.0)


def manufacturer(model: Column | str) -> Column:
    """F-3: manufacturer from the first whitespace-separated word of the model."""
    first_word = F.lower(F.regexp_extract(_col(model), r"^\s*(\S+)", 1))
    expr = None
    for word, name in MANUFACTURER_BY_FIRST_WORD.items():
        expr = (F.when(first_word == word, name) if expr is None
                else expr.when(first_word == word, name))
    return expr


def flight_number(number: Column | str) -> Column:
    """F-4: last blank-separated token of the flight number; missing -> ``''``."""
    return F.substring_index(F.coalesce(_col(number), F.lit("")), " ", -1)


def first_nonblank(preferred: Column | str, fallback: Column | str) -> Column:
    """F-5: ``preferred`` unless it is NULL or empty, else ``fallback``."""
    return F.coalesce(F.nullif(_col(preferred), F.lit("")), _col(fallback))


def in_flag(c: Column | str, values: Iterable[str]) -> Column:
    """F-6: membership test that is False (not NULL) for a NULL input."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def flag_int(c: Column | str) -> Column:
    """F-7: boolean with NULL as False, stored as 0/1."""
    return F.coalesce(_col(c), F.lit(False)).cast("int")


def flight_type(origin_country: Column | str, dest_country: Column | str) -> Column:
    """F-8: 'Domestic' when both countries are known and equal, else 'International'."""
    return (F.when(_col(origin_country) == _col(dest_country), F.lit("Domestic"))
            .otherwise(F.lit("International")))


def round_half_up(x: Column | str, digits: int = 2) -> Column:
    """ROUND(x, digits) half-up on the decimal value, returned as double."""
    return F.round(_col(x).cast("decimal(28,12)"), digits).cast("double")


def pct_round(numerator: Column | str, denominator: Column | str, digits: int = 2) -> Column:
    """F-9: ROUND(num * 100.0 / den, digits); NULL (not an error) when den is 0."""
    ratio = F.try_divide(_col(numerator).cast("double") * F.lit(100.0), _col(denominator))
    return round_half_up(ratio, digits)


def pct(numerator: Column | str, denominator: Column | str) -> Column:
    """F-10: num / den * 100, unrounded; NULL when den is 0."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator)) * F.lit(100.0)


def sum_flag(condition: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END): NULL-safe count of true rows, NULL over no rows."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("long")
