"""Every registered query against its DuckDB oracle on sf0.001 (rows, columns, values)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from flightops import oracle, registry  # noqa: E402
from check_oracle import TABLES, canon  # noqa: E402

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(small_sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{small_sf}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, small_sf, name):
    df = entry.queries()[name](spark, small_sf)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert canon(df.columns, rows) == canon(ocols, orows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 10
    assert df.columns == ["airport_name", "city", "iata_code", "total_arrivals",
                          "delayed_arrivals", "delay_percentage"]
