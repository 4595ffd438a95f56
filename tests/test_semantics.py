"""Reference semantics (SURVEY E-list) and properties on hand-made stars."""

import datetime as dt

from pyspark.sql import functions as F

from flightops.operators.dims import aircraft_dimension
from flightops.plans import dashboard as H
from flightops.plans import reports as Q
from helpers import T0, airports, flights


def star(spark):
    f = flights(spark, [
        dict(flight_id="AI 1", airline_name="Air India", aircraft_reg="VT-A", aircraft_model="Airbus A320",
             origin_icao="VIDP", dest_icao="VABB", status="Arrived", scheduled_arr=T0, delay_arr=5.0,
             scheduled_dep=T0, delay_dep=3.0, seq=1),
        dict(flight_id="AI 1", airline_name="Air India", aircraft_reg="VT-A", aircraft_model="Airbus A320",
             origin_icao="VIDP", dest_icao="VABB", status="Arrived", scheduled_arr=T0, delay_arr=5.0,
             scheduled_dep=T0, delay_dep=3.0, seq=2),          # E1: the same flight again
        dict(flight_id="EK 2", airline_name="Emirates", aircraft_reg="A6-B", aircraft_model="Boeing 777",
             origin_icao="OMDB", dest_icao="VIDP", status="Delayed", delay_arr=None,
             scheduled_arr=T0 + dt.timedelta(hours=1), delay_dep=-4.0, seq=3),
        dict(flight_id="BA 3", airline_name=None, aircraft_reg="G-C", aircraft_model="boeing 787",
             origin_icao="EGLL", dest_icao="XXXX", status="Canceled", delay_dep=None, seq=4),
        dict(flight_id=None, airline_name="Air India", aircraft_reg="VT-A", aircraft_model="Airbus A321",
             origin_icao="VABB", dest_icao="VOMM", status=None, delay_arr=12.0, seq=5),
        dict(flight_id="6E 5", airline_name="IndiGo", aircraft_reg="", aircraft_model="ATR 72",
             origin_icao="ZZZZ", dest_icao="VIDP", status="Canceled", seq=6),
        dict(flight_id="6E 6", airline_name="IndiGo", aircraft_reg=None, aircraft_model="ATR 72",
             origin_icao="VOMM", dest_icao="VIDP", status="Unknown", seq=7),
    ])
    a = airports(spark)
    return f, a, aircraft_dimension(f)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_aircraft_first_seen_and_blank_regs(spark):
    f, _, ac = star(spark)
    got = {r["aircraft_reg"]: (r["aircraft_model"], r["manufacturer"], r["airline_name"]) for r in ac.collect()}
    # E18: first row per registration; null and empty registrations skipped
    assert got == {"VT-A": ("Airbus A320", "Airbus", "Air India"),
                   "A6-B": ("Boeing 777", "Boeing", "Emirates"),
                   "G-C": ("boeing 787", "Boeing", None)}


def test_first_seen_follows_order_not_input_position(spark):
    f = flights(spark, [dict(aircraft_reg="R1", aircraft_model="Cessna 208", seq=9),
                        dict(aircraft_reg="R1", aircraft_model="Embraer 190", seq=2)])
    assert rows(aircraft_dimension(f).select("aircraft_model")) == [("Embraer 190",)]


def test_flights_per_model_is_a_bag_and_counts_ids(spark):
    f, _, ac = star(spark)
    got = dict(rows(Q.flights_per_model(f, ac)))
    # two identical AI 1 rows count twice (E1); the row with NULL id is not counted (E2)
    assert got == {"Airbus A320": 2, "Boeing 777": 1, "boeing 787": 1}


def test_busy_aircraft_threshold(spark):
    f, _, ac = star(spark)
    assert rows(Q.busy_aircraft(f, ac, min_flights=1)) == [("VT-A", "Airbus A320", "Airbus", 2)]


def test_airport_reports(spark):
    f, a, _ = star(spark)
    assert rows(Q.outbound_airports(f, a, 1)) == [("Delhi", "New Delhi", "India", 2)]
    assert rows(Q.top_destinations(f, a, 2)) == [("Delhi", "New Delhi", "India", 3),
                                                 ("Mumbai", "Mumbai", "India", 2)]


def test_flight_type_null_country_and_unknown_ends(spark):
    f, a, _ = star(spark)
    got = rows(Q.flight_type(f, a, limit=None).select("flight_number", "flight_type"))
    # E6: Chennai has no country -> International; ZZZZ->VIDP kept (one end known)
    assert sorted(got) == sorted([("1", "Domestic"), ("1", "Domestic"), ("2", "International"),
                                  ("3", "International"), ("", "International"),
                                  ("5", "International"), ("6", "International")])
    counts = dict(rows(Q.flight_type_counts(f, a)))
    assert counts == {"Domestic": 2, "International": 5}


def test_latest_arrivals_inner_on_dest(spark):
    f, a, ac = star(spark)
    got = rows(Q.latest_arrivals(f, ac, a, "DEL", 5))
    assert [r[0] for r in got] == ["2", "5", "6"]  # NULL scheduled_arr last
    assert got[0][1:4] == ("Boeing 777", "Boeing", "Dubai")


def test_airports_without_arrivals_anti_join(spark):
    f, a, _ = star(spark)
    # E8: Chennai is a destination only of a flight with NULL id; it still counts as used
    assert rows(Q.airports_without_arrivals(f, a).select("iata_code")) == [("DXB",), ("LHR",)]


def test_status_by_airline_null_group(spark):
    f, _, _ = star(spark)
    got = {r["airline_name"]: r for r in Q.status_by_airline(f).collect()}
    assert None in got                       # E9
    assert got["Air India"]["arrived"] == 2 and got["Air India"]["total_flights"] == 2
    assert got[None]["canceled"] == 1
    for r in got.values():                   # property: status counts <= total rows
        assert sum(r[c] for c, _ in Q.STATUS_COUNT_COLUMNS) <= 3


def test_cancelled_only_exact_status(spark):
    f, a, _ = star(spark)
    got = {r[0]: r[2] for r in rows(Q.cancelled_flights(f, a))}
    # 'Canceled' only (E4); unknown destination kept by the left join (E7)
    assert got == {"3": None, "5": "Delhi"}


def test_city_pairs_sorted_model_list(spark):
    f = flights(spark, [dict(origin_icao="VIDP", dest_icao="VABB", aircraft_reg=f"R{i}",
                             aircraft_model=m) for i, m in enumerate(["B", "A", "C", "A"])])
    ac = aircraft_dimension(f)
    got = rows(Q.city_pair_models(f, airports(spark), ac, min_models=2))
    assert got == [("New Delhi", "Mumbai", "DEL", "BOM", 3, "A,B,C")]


def test_delayed_pct_three_valued_logic(spark):
    f, a, _ = star(spark)
    got = {r["iata_code"]: r for r in Q.delayed_pct_by_destination(f, a).collect()}
    # DEL: EK 2 (Delayed), 6E 5, 6E 6 -> 1 of 3
    assert (got["DEL"]["total_arrivals"], got["DEL"]["delayed_arrivals"], got["DEL"]["delay_percentage"]) == (3, 1, 33.33)
    # MAA: only a NULL-id flight: COUNT(flight_id) = 0, HAVING drops it
    assert "MAA" not in got


def test_kpis_one_row(spark):
    f, a, ac = star(spark)
    assert rows(H.kpis(f, ac, a)) == [(7, 3, 5, 3)]


def test_explorer_metrics_ignore_status(spark):
    f, a, _ = star(spark)
    m_all = H.explore_metrics(f, a).collect()[0]
    assert (m_all["total_flights"], m_all["canceled_flights"]) == (6, 1)
    assert abs(m_all["canceled_pct"] - 100 / 6) < 1e-9
    empty = H.explore_metrics(f, a, airline="Nobody").collect()[0]
    assert tuple(empty) == (0, 0, 0.0)
    table = H.explore_table(f, a, status="Arrived")
    assert table.count() == 2 and H.explore_base(f, a).count() == 6


def test_fleet_and_manufacturers(spark):
    f, _, ac = star(spark)
    got = rows(H.fleet_models(f, ac))
    assert got[0] == ("Airbus A320", "Airbus", 2, 1)
    assert dict(rows(H.manufacturers(ac))) == {"Boeing": 2, "Airbus": 1}


def test_delays(spark):
    f, a, _ = star(spark)
    total, delayed, avg, mx = rows(H.delay_overview(f))[0]
    assert (total, delayed, avg, mx) == (7, 2, 3.0, 3.0)
    got = rows(H.delays_by_airport(f, a, 0))
    assert got[0] == ("Delhi", "DEL", 2, 2, 3.0, 100.0)


def test_empty_input_aggregates_are_null(spark):
    f, a, _ = star(spark)
    none = f.where(F.lit(False))
    assert rows(H.delay_overview(none)) == [(0, None, None, None)]   # E17


def test_property_anti_join_plus_destinations_cover_airports(spark):
    f, a, _ = star(spark)
    without = {r[0] for r in Q.airports_without_arrivals(f, a).select("airport_name").collect()}
    with_arr = {r[0] for r in Q.top_destinations(f, a, 100).select("airport_name").collect()}
    # Q-7 and Q-4 without limit partition the airports
    assert without | with_arr == {r[0] for r in a.select("name").collect()}
    assert not without & with_arr


def test_explorer_origin_filter(spark):
    f, a, _ = star(spark)
    assert sorted(r.origin for r in H.explore_base(f, a, origin="DEL").collect()) == ["DEL", "DEL"]
    assert H.explore_base(f, a, airline="Air India", origin="BOM").count() == 1


def test_cancelled_order_nulls_last(spark):
    # E13: DESC with NULLs last, spelled out
    f = flights(spark, [dict(flight_id="X 1", status="Canceled", scheduled_dep=None),
                        dict(flight_id="X 2", status="Canceled", scheduled_dep=T0),
                        dict(flight_id="X 3", status="Canceled", scheduled_dep=T0 + dt.timedelta(hours=1))])
    got = [r.flight_number for r in Q.cancelled_flights(f, airports(spark)).collect()]
    assert got == ["3", "2", "1"]


def test_string_equality_is_exact(spark):
    # E21: case-sensitive, no trimming
    f, a, _ = star(spark)
    assert H.explore_base(f, a, airline="air india").count() == 0
    assert H.explore_base(f, a, airline="Air India ").count() == 0
    assert Q.cancelled_flights(f, a, status="canceled").count() == 0


def test_kpis_on_no_flights(spark):
    f, a, ac = star(spark)
    assert rows(H.kpis(f.where(F.lit(False)), ac, a)) == [(0, 3, 5, 0)]


def test_explore_one_call(spark):
    f, a, _ = star(spark)
    ex = H.explore(f, a, status="Canceled")
    assert ex.table.count() == 1                       # BA 3 from LHR; 6E 5 has no known origin
    assert rows(ex.metrics)[0][:2] == (6, 1)           # metrics ignore the status choice


def test_cancelled_unordered_same_rows(spark):
    f, a, _ = star(spark)
    assert sorted(rows(Q.cancelled_flights(f, a, ordered=False)), key=str) == \
        sorted(rows(Q.cancelled_flights(f, a)), key=str)
