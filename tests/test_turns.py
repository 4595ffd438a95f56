"""What a run holds on disk at once: exchanges go, large tables are written in turns, streams run in slices."""

import glob
import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightops import registry, session
from flightops.functions import expressions as X
from flightops.session import local_path, new_scratch_path
from flightops.sources import fixture, lists, versions
from flightops.sources.store import warehouse
from flightops.streaming import dedup
from helpers import FLIGHTS_SCHEMA
from test_ingest import FLIGHT


def _shuffle_files(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))


def test_exchanges_go_with_their_statement(spark, tmp_path):
    df = spark.range(1000).repartition(4, "id")
    session.size_partitions(spark, small=True)
    try:
        before = _shuffle_files(spark)
        df.write.parquet(str(tmp_path / "t"))
        assert _shuffle_files(spark) <= before
        again = df.groupBy((F.col("id") % 3).alias("m")).count()
        assert sorted(again.collect()) == sorted(again.collect())    # what went is made again
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    finally:
        session.size_partitions(spark, small=False)


def _flights(spark, keys):
    """Flights by order number (NULL too), each with its number as flight id."""
    types = {f.name: f.dataType for f in FLIGHTS_SCHEMA.fields}
    order = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType())])
    schema = T.StructType([T.StructField(c, types[c]) for c in fixture._DOC_COLUMNS] + [T.StructField("seen_order", order)])
    rows = [Row(**{c: None for c in fixture._DOC_COLUMNS} | {"seen_order": (k, n), "flight_id": f"n {k} {n}", "is_cargo": n % 2,
                                                            "origin_iata": "A01"}) for k, n in keys]
    return spark.createDataFrame([[r[c] for c in schema.fieldNames()] for r in rows], schema)


def test_turns_hold_every_flight_once(spark, small_sf):
    flights = _flights(spark, [(k, n) for k in (None, 1, 2, 3, 500, 501) for n in (1, 2, 2)])
    turns = fixture.by_turns(flights, 3)
    assert len(turns) == 3 and fixture.by_turns(flights, 1) == [flights]

    def lines(*parts):
        return sorted(r[0] for p in parts for r in fixture.landed_envelopes(p).select(F.to_json(F.struct("*"))).collect())
    assert lines(*turns) == lines(flights)
    assert registry._turns(spark, warehouse(spark, small_sf)) == 1
    assert registry._turns(spark, warehouse(spark, small_sf), 1) == registry.MAX_TURNS


def test_long_lists_in_turns(spark, tmp_path):
    a_list = fixture.LIST_ORDERS * fixture.LONG_LIST_PARTS
    keys = [(k, n) for k in (None, 5, 3, fixture.LIST_ORDERS + 1, a_list, a_list + 7, 3 * a_list) for n in (2, 1, 1)]
    flights = _flights(spark, keys).repartition(3)
    found = []
    for turns in (1, 3):
        path = str(tmp_path / f"lists-{turns}")
        fixture.write_long_lists(flights, path, turns)
        files = [f for f in glob.glob(f"{path}/list=*/part-*") if os.path.getsize(f)]
        assert len(files) == 4                                    # one a list
        held = [[f["number"] for f in json.load(open(p))] for p in files]
        found.append(sorted(held))
        for numbers in held:
            order = [[int(x) for x in n.split(" ")[1:] if x != "None"] for n in numbers if "None" not in n]
            assert order == sorted(order)
        read = lists.read_flight_list_split(spark, path)
        assert sorted(str(r["number"]) for r in read.collect()) == sorted(str(x) for h in held for x in h)
    assert found[0] == found[1] and sum(map(len, found[0])) == len(keys)


def test_lists_are_cut_in_turns(spark, tmp_path, monkeypatch):
    root = tmp_path / "a b"
    root.mkdir()
    want = []
    for name in ("x[1].json", "y +z%20.json", "plain.json"):
        docs = [{"number": f"{name} {i}", "aircraft": {"reg": '}{"][\\"'}} for i in range(40)]
        (root / name).write_text(json.dumps(docs))
        want += [d["number"] for d in docs]
    before = sorted(map(str, lists.list_documents(spark, str(root)).collect()))
    monkeypatch.setattr(lists, "TURN_BYTES", 1)
    assert [len(t) for t in lists._turns(lists._files(spark, str(root)))] == [1, 1, 1]
    got = lists.list_documents(spark, str(root)).collect()
    assert sorted(map(str, got)) == before
    assert sorted(json.loads(r["text"])["number"] for r in got) == sorted(want)
    assert len({r["file"] for r in got}) == 3


def test_pieces_are_exchanged_without_the_path(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"number": "a"}, {"number": "b"}]')
    pieces = lists._pieces(spark, [str(tmp_path / "a.json")])
    assert dict(pieces.dtypes)["_file"] == "bigint"


ODD_TIMES = ["2025-11-20 06:05Z", "2025-11-20 06:05", "2025-11-20 6:5Z", "2025-02-30 06:05Z", "2025-13-01 00:00Z", "2025-11-20 24:00Z",
             "2025-11-20 06:05 ", "2025-11-20 06:05\n", " 2025-11-20 06:05", "2025-11-20T06:05Z", "2025-11-20 06:05:00", "", "Z", None,
             "0001-01-01 00:00Z", "9999-12-31 23:59Z", "1582-10-10 00:00Z", "2024-02-29 23:59Z", "20251-1-20 06:05", "2025-11-20 06:5Z",
             "2025-11-20 06h05Z", "2Z025-11-20 06:05", "2025-11-20 06:05ZZ", "٢٠٢٥-11-20 06:05Z", "2025-00-10 00:00Z"]


def test_full_width_times_equal_the_pattern(spark):
    df = spark.createDataFrame([(t,) for t in ODD_TIMES], "t string")
    by_pattern = F.try_to_timestamp(F.translate("t", "Z", ""), F.lit(X.UTC_TIME_PATTERN)).cast("timestamp_ntz")
    rows = df.select("t", X.parse_utc_time("t").alias("got"), by_pattern.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and sum(r["got"] is not None for r in rows) > 5
    plain = df.where(F.col("t").rlike(X.FULL_UTC_TIME))
    assert sorted(r["t"] for r in plain.collect())[0] == "0001-01-01 00:00Z"


def test_merged_landings_parse_the_lines_once(spark, small_sf, monkeypatch):
    read = []

    class Stop(Exception):
        pass

    def first(spark, path, airports, flights, *rest):
        read.extend(flights.inputFiles())
        raise Stop
    monkeypatch.setattr(versions, "prepare_replace", first)
    monkeypatch.setattr(registry, "_ONCE", {k: v for k, v in registry._ONCE.items() if k[2] != "merged-star"})
    with pytest.raises(Stop):
        registry.merged_star(spark, small_sf)
    assert read and all(f.endswith(".parquet") for f in read)     # before: the JSON, once a landing


def test_sightings_carry_the_request_once(spark):
    schema = ("aircraft_reg string, aircraft_model string, airline_name string, "
              "seen_order struct<poll:string,airport:string,window_from:string,pos:int>")
    rows = [("R1", "m2", "a", ("p", "X", "2024-01-01T00:00", 2)), ("R1", "m1", None, ("p", "X", "2024-01-01T00:00", 1)),
            ("R1", "m3", "b", (None, "Y", None, 0)), ("R1", "m4", "b", (None, None, None, 0))]
    new = versions._owned(spark.createDataFrame(rows, schema))
    found = versions._sightings(new)
    assert found.schema["first"].dataType["seen"].dataType.fieldNames() == ["poll", "airport", "window_from", "pos"]
    whole = versions._sights(new).groupBy("aircraft_reg", *versions.OWNER).agg(F.min("first").alias("first"))
    assert sorted(map(str, found.select("first").collect())) == sorted(map(str, whole.select("first").collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = "\n".join(plan[plan.index("RepartitionByExpression"):].split("\n")[1:])
    assert "seen, struct(poll," in below        # before: the order as it stands, with the request in it


def _land(path, name, envelopes):
    os.makedirs(local_path(path), exist_ok=True)
    with open(os.path.join(local_path(path), name), "w") as fh:
        fh.write("\n".join(json.dumps(e) for e in envelopes) + "\n")


def test_slices_hold_the_flights_of_one_stream(spark):
    landing_dir = new_scratch_path(spark, "sliced-landing")
    made = [dict(FLIGHT, number=f"AI {i}") for i in range(30)]
    untimed = dict(FLIGHT, number="XX 9", departure={"airport": {"iata": "DEL", "icao": "VIDP"}})
    _land(landing_dir, "a.json", [{"airport": "DEL", "window_idx": 0, "departures": made[:20] + [untimed, untimed]},
                                  {"airport": "BOM", "window_idx": 0, "arrivals": made[:20]}])
    kept = []
    for slices in (1, 3):
        root = new_scratch_path(spark, "sliced")
        paths = dedup.DedupPaths(f"{root}/flights", f"{root}/untimed", f"{root}/ckpt", slices)
        dedup.run_dedup_ingest(spark, landing_dir, paths, salt_buckets=2)
        assert dedup.streamed_dedup(spark, paths).count() == 21
        kept.append((paths, dedup.streamed_dedup(spark, paths).drop("seen_order").collect()))
    assert sorted(map(str, kept[0][1])) == sorted(map(str, kept[1][1]))     # columns that weren't exchanged too
    paths = kept[1][0]
    assert len(glob.glob(f"{local_path(paths.bronze)}/complete=true/slice=*")) == 3
    # a later run finds what an earlier one kept, in every slice
    _land(landing_dir, "b.json", [{"airport": "DEL", "window_idx": 1, "departures": made}])
    dedup.run_dedup_ingest(spark, landing_dir, paths, salt_buckets=2)
    got = sorted(r.flight_id for r in dedup.streamed_dedup(spark, paths).collect())
    assert got == sorted([f["number"] for f in made] + ["XX 9"])
    assert dedup.reconcile_dedup(spark, paths, dedup.DEDUP_KEYS).count() == 31
