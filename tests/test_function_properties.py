"""Property tests: column expressions against plain-Python statements of their contract,
on generated inputs (one Spark job per example batch)."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from flightops.functions import expressions as X


def spark_values(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr("v")).collect()]


def strptime_contract(s):
    """F-1 contract: blank or non-text -> None; drop every 'Z'; then year-month-day
    hour:minute, anything else -> None."""
    if not isinstance(s, str) or not s.strip():
        return None
    try:
        return dt.datetime.strptime(s.replace("Z", ""), "%Y-%m-%d %H:%M")
    except ValueError:
        return None


def pad(n, width, padded):
    return str(n).zfill(width) if padded else str(n)


time_text = st.builds(
    lambda y, mo, d, h, mi, p, z: (f"{y}-{pad(mo, 2, p[0])}-{pad(d, 2, p[1])} "
                                   f"{pad(h, 2, p[2])}:{pad(mi, 2, p[3])}" + ("Z" if z else "")),
    st.integers(1900, 2100), st.integers(0, 13), st.integers(0, 32), st.integers(0, 25),
    st.integers(0, 61), st.tuples(st.booleans(), st.booleans(), st.booleans(), st.booleans()),
    st.booleans())


@settings(max_examples=8, deadline=None)
@given(st.lists(time_text, min_size=20, max_size=60))
def test_time_parse_matches_strptime(spark, texts):
    assert spark_values(spark, texts, X.parse_utc_time) == [strptime_contract(t) for t in texts]


number_text = st.one_of(st.none(), st.text(alphabet="AI0123 -", max_size=12))


@settings(max_examples=8, deadline=None)
@given(st.lists(number_text, min_size=20, max_size=60))
def test_flight_number_is_last_blank_token(spark, numbers):
    expected = [("" if n is None else n).split(" ")[-1] for n in numbers]
    assert spark_values(spark, numbers, X.flight_number) == expected


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet="ab ", max_size=3)),
                          st.one_of(st.none(), st.text(alphabet="cd", max_size=2))),
                min_size=10, max_size=40))
def test_first_nonblank_is_python_or(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(X.first_nonblank("a", "b")).collect()]
    assert got == [a or b for a, b in pairs]
