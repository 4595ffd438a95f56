"""Mergeable day sketches, kept violations, the profile by sketches, the clustered fact."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flightops import schemas
from flightops.operators import audit, cluster, sketches
from flightops.session import new_scratch_path
from helpers import T0, airports, flights


def test_sketches_unite_over_days(spark):
    rows = [dict(scheduled_dep=T0 + dt.timedelta(days=k % 9), airline_name=f"a{k % 30}" if k % 11 else None,
                 aircraft_reg=["", None, *(f"R{j}" for j in range(2000))][k % 2002], aircraft_model="ATR") for k in range(5000)]
    fact = flights(spark, rows).withColumn(schemas.FLIGHT_DATE, F.to_date("scheduled_dep"))
    daily = sketches.daily_sketches(fact)
    assert daily.count() == 9
    got = sketches.distinct_between(daily, "2025-11-21", "2025-11-25").first()
    kept = [r for r in rows if dt.datetime(2025, 11, 21) <= r["scheduled_dep"] < dt.datetime(2025, 11, 26)]
    regs = len({r["aircraft_reg"] for r in kept} - {"", None})
    assert got.n_flights == len(kept) and got.n_models == 1
    assert got.n_airlines == len({r["airline_name"] for r in kept} - {None})
    assert abs(got.n_aircraft - regs) <= 4 * sketches.ERROR * regs
    assert sketches.distinct_between(daily, "2030-01-01", "2030-01-02").first().n_flights is None


def test_kept_violations_count_like_the_audit(spark):
    rows = [dict(flight_id="A 1", origin_icao="VIDP", dest_icao="VABB", aircraft_reg="R1")] * 3
    rows += [dict(flight_id=None, origin_icao="XXXX", dest_icao="VABB"), dict(flight_id="A 2", origin_icao="XXXX", dest_icao="YYYY"),
             dict(flight_id="A 3", origin_icao=None, dest_icao=None, aircraft_reg="R9"), dict(flight_id="A 4", origin_icao="VIDP")]
    fact = flights(spark, [dict(r) for r in rows])
    codes = airports(spark).unionByName(airports(spark).where("iata_code = 'DEL'")).unionByName(
        airports(spark).where("iata_code = 'BOM'").withColumn("iata_code", F.lit(None).cast("string")).withColumn("icao_code", F.lit("ZZZZ")))
    planes = spark.createDataFrame([("R1", "m", "f", "a"), ("R1", "m", "f", "a"), (None, "m", "f", "a")],
                                   "aircraft_reg string, aircraft_model string, manufacturer string, airline_name string")
    delays = spark.createDataFrame([("DEL", 1), ("QQQ", 2), (None, 3)], "airport_iata string, total_flights int")
    found = audit.violations(fact, codes, planes, delays)
    path = new_scratch_path(spark, "quarantine-test")
    for name in ("first", "second", "first"):
        audit.keep_violations(found, path, name)
    kept = spark.read.parquet(path).where("landing = 'first'")
    want = {r.constraint_name: r.violations for r in audit.constraint_audit(fact, codes, planes, delays).collect() if r.violations}
    assert {r.constraint_name: r.violations for r in audit.violation_counts(kept).collect()} == want
    assert len(want) == 11 and want["flights_pk_unique"] == 1
    assert kept.where("constraint_name = 'flights_pk_unique'").count() == 3
    assert '"dest_icao":"YYYY"' in kept.where("constraint_name = 'flights_dest_fk'").first().row


def test_profile_by_sketches_has_the_exact_top_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "x", "y", None]), k, float(k % 3) if k % 7 else None, T0 + dt.timedelta(days=k % 4), k % 5 == 0, None)
            for k in range(4000)]
    rows += [("x", None, 0.0, T0, True, None)] * 500
    df = spark.createDataFrame(rows, "a string, `b.c` long, d double, t timestamp_ntz, f boolean, n string")
    exact = {r.column_name: r for r in audit.table_profile(df, "t").collect()}
    quick = {r.column_name: r for r in audit.table_profile(df, "t", exact=False, top_values=True).collect()}
    for c in ("a", "d", "t", "f"):
        assert quick[c] == exact[c]
    assert quick["n"].top_value is None and quick["n"].non_null_count == 0
    # no value of a unique column is proven to be the most frequent one
    assert quick["b.c"].top_value is None and abs(quick["b.c"].distinct_count - 4000) < 400
    assert audit.table_profile(df.limit(0), "t", exact=False, top_values=True).where("row_count = 0").count() == 6


def _rows_read(df):
    """Rows that the scan handed on, from the executed plan's own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_clustered_fact_skips_row_groups(spark):
    rng = random.Random(9)
    n = 60_000
    rows = [(T0 + dt.timedelta(minutes=rng.randrange(1400)), f"air {min(int(rng.expovariate(0.08)), 59)}",
             f"N{rng.randrange(40):03d}", rng.choice(["Arrived"] * 6 + ["Canceled", "Delayed"]), f"{k} {'x' * 40}") for k in range(n)]
    fact = spark.createDataFrame(rows, "scheduled_dep timestamp_ntz, airline_name string, origin_icao string, status string, flight_id string")
    fact = fact.withColumn(schemas.FLIGHT_DATE, F.to_date("scheduled_dep")).coalesce(1)
    plain, sorted_ = new_scratch_path(spark, "plain"), new_scratch_path(spark, "clustered")
    size = 64 << 10
    fact.write.option("parquet.block.size", size).partitionBy(schemas.FLIGHT_DATE).parquet(plain)
    cluster.write_clustered(fact, sorted_, schemas.FLIGHT_DATE, size)
    a, b = spark.read.parquet(plain), spark.read.parquet(sorted_)
    assert b.count() == n and a.exceptAll(b).isEmpty()
    for test in ("airline_name = 'air 40'", "origin_icao = 'N007'", "airline_name = 'air 3' and status = 'Canceled'"):
        before, after = _rows_read(a.where(test).select("flight_id")), _rows_read(b.where(test).select("flight_id"))
        assert before > 0.8 * n and after < 0.5 * before, (test, before, after)


@pytest.mark.parametrize("bits", [1, 8])
def test_z_key_interleaves_hash_bits(spark, bits):
    df = spark.createDataFrame([("a", None, "c"), ("a", "b", None)], "x string, y string, z string")
    got = df.select(cluster.z_key(("x", "y", "z"), bits).alias("k"), *[F.xxhash64(c).alias(c) for c in "xyz"]).collect()
    for r in got:
        want = "".join(str((h & (2 ** 64 - 1)) >> (63 - b) & 1) for b in range(bits) for h in (r.x, r.y, r.z))
        assert r.k == int(want, 2)
