"""What grows with the tables stays small: landed files, exchanges, and what one task holds."""

import datetime as dt
import glob
import json

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightops import registry, session
from flightops.operators import audit
from flightops.operators.dims import aircraft_dimension
from flightops.sources import fixture, lists, versions
from flightops.sources.store import warehouse
from flightops.streaming import dedup
from helpers import FLIGHTS_SCHEMA


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_made_after_the_exchange(spark, small_sf):
    flights = warehouse(spark, small_sf).flights
    for both in (False, True):
        plan = _plan(fixture.landed_envelopes(flights, both))
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        # one exchange, by order alone, of plain columns (both ends: the same one for either leg)
        assert dealt and all("hashpartitioning(chunk" in line for line in dealt)
    lines = _plan(fixture.damaged_landing(flights))
    assert lines.count("Exchange hashpartitioning") == 1


def test_landings_are_compressed(spark, small_sf):
    path = session.local_path(registry.landed_path(spark, small_sf))
    assert glob.glob(f"{path}/*.json.gz") and not glob.glob(f"{path}/*.json")


def test_saved_lists_are_compressed_and_made_after_the_exchange(spark, small_sf):
    plan = _plan(fixture.saved_lists(warehouse(spark, small_sf).flights))
    exchange = [k for k, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line]
    gathered = [k for k, line in enumerate(plan.splitlines()) if "partial_collect_list" in line]
    # one exchange, of plain columns: documents are made and gathered above it
    assert len(exchange) == 1 and gathered and max(gathered) < exchange[0]
    registry.restore_flights(spark, small_sf)
    path = session.local_path(registry._once(spark, small_sf, "saved-lists", lambda p: None))
    assert glob.glob(f"{path}/*.txt.gz") and not glob.glob(f"{path}/*.txt")


def test_lists_hold_all_flights_in_order(spark):
    made = [(k, None if k % 7 == 0 else f"n {k}") for k in (9000, 3, 5, 4096, 1, 5, 8191)]
    rows = [Row(**{c: None for c in fixture._DOC_COLUMNS} | {"seen_order": Row(l_orderkey=k, l_linenumber=1), "flight_id": n,
                                                            "is_cargo": k % 2}) for k, n in made]
    types = {f.name: f.dataType for f in FLIGHTS_SCHEMA.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in fixture._DOC_COLUMNS] + [T.StructField("seen_order", T.StructType(
        [T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType())]))])
    df = spark.createDataFrame([[r[c] for c in schema.fieldNames()] for r in rows], schema)
    got = sorted([f.get("number") for f in json.loads(r["value"])] for r in fixture.saved_lists(df.union(df.where("false"))).collect())
    assert got == [["n 1", "n 3", "n 5", "n 5"], ["n 4096", "n 8191"], ["n 9000"]]


def test_fact_is_not_exchanged_by_supplier(spark, small_sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)      # as if every side were large
    try:
        plan = _plan(fixture.flights(spark, small_sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(l_partkey" in plan and "hashpartitioning(l_suppkey" not in plan


def test_dimension_holds_a_candidate_once(spark, small_sf):
    flights = warehouse(spark, small_sf).flights
    dealt = [line for line in _plan(aircraft_dimension(flights)).splitlines() if "partial_" in line]
    # the buffer is the order with the values, not these beside them
    assert dealt and all("min_by" not in line and "partial_min" in line for line in dealt)


def test_damage_by_order_of_the_envelope(spark, small_sf):
    flights = warehouse(spark, small_sf).flights
    kind = F.col("seen_order.l_orderkey") % fixture.DAMAGE_EVERY
    n = {r["k"]: r["n"] for r in flights.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect()}
    lines = [r["value"] for r in fixture.damaged_landing(flights).collect()]
    whole = fixture.landed_envelopes(flights.where(kind == fixture.NO_ARRAYS)).count()
    assert sum('"no_departures":' in line or '"no_arrivals":' in line for line in lines) == whole
    assert sum(not line.endswith("}") for line in lines) == \
        fixture.landed_envelopes(flights.where(kind == fixture.BROKEN)).count()
    assert set(n) == set(range(fixture.DAMAGE_EVERY))


def test_partitions_by_bytes_and_back(spark):
    keys = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    session.size_partitions(spark, small=False)     # as the session came, whatever ran before
    before = [spark.conf.get(k, None) for k in keys]
    session.size_partitions(spark, small=True)
    assert [int(spark.conf.get(k)) for k in keys] == [session.FIRST_PARTITIONS, session.PARTITION_BYTES, session.SPLIT_BYTES]
    session.size_partitions(spark, small=False)
    assert [spark.conf.get(k, None) for k in keys] == before


def test_broken_rows_need_no_exchange_of_the_fact(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [("F1", "N000", "N001", "R-1", day), ("F1", "N000", "N009", "R-2", day), ("F2", "N000", None, None, day),
            (None, "N000", "N001", "R-9", day), ("F3", "N000", "N001", "R-9", day)]
    flights = spark.createDataFrame(rows, "flight_id string, origin_icao string, dest_icao string, aircraft_reg string, t timestamp_ntz")
    airports = spark.createDataFrame([("N000", "A0"), ("N001", "A1")], "icao_code string, iata_code string")
    aircraft = spark.createDataFrame([("R-1",), ("R-2",), (None,)], "aircraft_reg string")
    found = audit.violations(flights, airports, aircraft)
    got = sorted((r["constraint_name"], r["key"] or "") for r in found.collect())
    assert got == [("aircraft_reg_not_null", ""), ("flights_aircraft_fk", "R-9"), ("flights_aircraft_fk", "R-9"),
                   ("flights_dest_fk", "N009"), ("flights_pk_not_null", ""),
                   ("flights_pk_unique", "F1"), ("flights_pk_unique", "F1")]
    audit.keep_violations(found, str(tmp_path / "kept"), "first")
    assert spark.read.parquet(str(tmp_path / "kept")).count() == len(got)
    plan = _plan(found)
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)


def test_lists_are_cut_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"number": "a } \\" {", "aircraft": {"reg": "[R"}}, {"number": "b"}]')
    docs = lists.list_documents(spark, str(tmp_path))
    assert [r["text"] for r in docs.orderBy("pos").collect()] == \
        ['{"number": "a } \\" {", "aircraft": {"reg": "[R"}}', '{"number": "b"}']
    # one read of the files, before: one a branch and a use of the maps
    assert _plan(docs).count("FileScan text") == 0


def test_both_ends_share_one_exchange(spark, small_sf):
    both = fixture.landed_envelopes(warehouse(spark, small_sf).flights, both_ends=True)
    assert _plan(both).count("Exchange hashpartitioning") == 1   # before: one for either leg
    lines = [r["line"] for r in both.select(F.to_json(F.struct("departures", "arrivals")).alias("line")).limit(50).collect()]
    assert all('"departure":{"airport":{"iata":' in line and '"aircraft":{' in line for line in lines)


def test_reconcile_exchanges_wanted_columns(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(2, "F1", day, "N0", "N1", "b"), (1, "F1", day, "N0", "N1", "a"), (3, "F2", day, "N0", "N1", "c"),
            (4, None, day, "N0", "N1", "d"), (5, None, day, "N0", "N1", "d"), (6, None, day, "N0", "N1", "e")]
    flights = spark.createDataFrame(rows, "seen_order int, flight_id string, scheduled_dep timestamp_ntz, "
                                          "origin_icao string, dest_icao string, aircraft_model string")
    for columns in (dedup.DEDUP_KEYS, [*dedup.DEDUP_KEYS, "aircraft_model"], ["seen_order", "flight_id"]):
        got = sorted(map(str, dedup.dedupe_first_seen(flights, columns).collect()))
        assert got == sorted(map(str, dedup.dedupe_first_seen(flights).select(*columns).collect()))
        assert len(got) == 4


def test_late_rows_are_found_by_keys(spark, tmp_path):
    key = ["departs", *dedup.DEDUP_KEYS]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in dedup._bronze_schema(spark).fields])
    paths = dedup.DedupPaths(str(tmp_path / "sink"), str(tmp_path / "untimed"), str(tmp_path / "ckpt"))
    day = dt.datetime(2024, 1, 1, 6)

    def rows(*numbers):
        values = {"scheduled_dep": day, "origin_icao": "N0", "dest_icao": "N1", "complete": True}
        made = spark.createDataFrame([tuple({**values, "flight_id": n}.get(f.name) for f in schema.fields) for n in numbers], schema)
        return made.drop("complete").withColumn("departs", F.date_format("scheduled_dep", "yyyy-MM-dd"))
    rows("A", "B").write.partitionBy("departs").parquet(paths.sink)
    late = dedup.late_flights(rows("A", "B", "C", "C"), paths)
    assert [r["flight_id"] for r in late.collect()] == ["C"]
    semi = [line for line in _plan(late).splitlines() if "LeftSemi" in line]
    # whole rows meet the late keys without an exchange (before: all of them were dealt)
    assert semi and all("BroadcastHashJoin" in line for line in semi) and key[0] in late.columns


def test_sightings_are_exchanged_once(spark):
    schema = ("aircraft_reg string, aircraft_model string, airline_name string, "
              "seen_order struct<airport:string,window_from:string,pos:int>")
    rows = [("R1", "m2", "a", ("X", "2024-01-01T00:00", 2)), ("R1", "m1", "a", ("X", "2024-01-01T00:00", 1)),
            ("R1", "m3", "b", ("Y", "2024-02-01T00:00", 0)), ("R2", "m", "c", ("X", None, 5)), ("", "m", "c", ("X", None, 6))]
    new = versions._owned(spark.createDataFrame(rows, schema))
    fresh = versions._sightings(new)
    got = sorted((r["aircraft_reg"], r["airport"], str(r["window_month"]), r["first"]["seen"]["pos"]) for r in fresh.collect())
    assert got == [("R1", "X", "2024-01", 1), ("R1", "Y", "2024-02", 0), ("R2", "X", "None", 5)]
    # those of an earlier version stay as they are, also beside one of the same request
    both = versions._sightings(new, fresh)
    assert both.count() == 2 * len(got) and both.columns == fresh.columns
    kept = versions._window_month(versions._sights(new))
    assert _plan(versions._sightings(new, kept)).count("Exchange hashpartitioning") == 1
    every = versions._dimension(versions._sights(new)).select("aircraft_reg", "aircraft_model", "airport").collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, versions._dimension(fresh).select("aircraft_reg", "aircraft_model", "airport").collect()))


def test_small_files_share_a_task(spark):
    session.size_partitions(spark, small=True)
    assert int(spark.conf.get("spark.sql.files.openCostInBytes")) == session.OPEN_BYTES
    session.size_partitions(spark, small=False)
