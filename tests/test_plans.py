"""Physical-plan properties the design relies on at scale (read from ``explain``)."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from flightops.operators.joins import sized_broadcast
from flightops.plans import dashboard as H
from flightops.plans import reports as Q
from flightops.sources.store import warehouse


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def star(spark, small_sf):
    return warehouse(spark, small_sf)


def test_fact_is_pruned_and_reduced_before_the_join(star):
    p = plan(Q.delayed_pct_by_destination(star.flights, star.airports_dim))
    assert "ReadSchema: struct<flight_id:string,dest_icao:string,delay_arr:double,status:string>" in p
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    # the fact's partial aggregate sits below the exchange that feeds the join
    assert p.index("partial_count(flight_id") > p.index("BroadcastHashJoin")


def test_explorer_predicates_reach_the_scan(star):
    p = plan(H.explore_table(star.flights, star.airports_dim, airline="X", status="Arrived"))
    assert "EqualTo(airline_name,X)" in p and "EqualTo(status,Arrived)" in p
    assert "TakeOrderedAndProject" in p


def test_anti_join_builds_from_distinct_destinations(star):
    p = plan(Q.airports_without_arrivals(star.flights, star.airports))
    assert "LeftAnti" in p
    # the fact contributes only its distinct destination codes, read as one column
    assert "Keys [1]: [dest_icao" in p
    assert "ReadSchema: struct<dest_icao:string>" in p


def test_kpis_have_no_cross_join(star):
    p = plan(H.kpis(star.flights, star.aircraft, star.airports))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_top_k_queries_use_take_ordered(star):
    for df in [Q.top_destinations(star.flights, star.airports_dim),
               Q.city_pair_models(star.flights, star.airports_dim, star.aircraft),
               H.fleet_models(star.flights, star.aircraft)]:
        assert "TakeOrderedAndProject" in plan(df)


def test_broadcast_only_within_the_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(1000).withColumnRenamed("id", "k")
        small = spark.range(10).withColumnRenamed("id", "k")
        hinted = plan(big.join(sized_broadcast(small, max_bytes=1000), "k"))
        assert "BroadcastHashJoin" in hinted
        unhinted = plan(big.join(sized_broadcast(big.select("k"), max_bytes=1000), "k"))
        assert "BroadcastHashJoin" not in unhinted and "SortMergeJoin" in unhinted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_star_dimensions_are_size_checked(star):
    assert star.rows["airports"] == 12
    assert "BroadcastHashJoin" in plan(star.flights.join(star.airports_dim,
                                                         F.col("origin_icao") == F.col("icao_code")))


def test_shuffle_join_reuses_the_aggregation_partitioning(spark, star):
    # the 100 TB case: nothing broadcast, no runtime re-planning
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            Q.flights_per_model(star.flights, star.aircraft).explain()
        p = buf.getvalue()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in p
    # per-registration counts are hash-partitioned once (for their own aggregation) and
    # joined as they are; the dimension is the only other side shuffled on the key
    assert p.count("Exchange hashpartitioning(aircraft_reg") == 2
    assert p.count("Exchange") - p.count("ReusedExchange") == 4


def test_a_range_of_days_reads_only_its_folders(spark, small_sf):
    from flightops import registry
    p = plan(registry.explore_days(spark, small_sf))
    filters = [x for x in p.splitlines() if "PartitionFilters" in x]
    assert any("flight_month" in x and "1995-03" in x and "1995-06" in x for x in filters)


def test_audit_scans_the_fact_three_times(star):
    from flightops.operators import audit
    p = plan(audit.constraint_audit(star.flights, star.airports, star.aircraft))
    assert sum("Location:" in x and x.rstrip().endswith("/flights]") for x in p.splitlines()) == 3


def test_no_python_in_any_registered_plan(spark, small_sf):
    from flightops import registry as entry
    python_nodes = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                    "PythonUDF", "MapInArrow")
    for name, fn in entry.queries().items():
        p = plan(fn(spark, small_sf))
        assert not any(n in p for n in python_nodes), name
