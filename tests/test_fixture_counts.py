"""Row counts per operator at sf0.001 as recorded in FIXTURES.md (section 3), a check
independent of the oracle SQL."""

import pytest

import __spark_entry__ as entry

EXPECTED_SF0001 = {
    "aircraft_dim": 178,
    "flights_per_model": 121,
    "busy_aircraft": 77,
    "outbound_airports": 0,
    "top_destinations": 3,
    "flight_type": 200,
    "flight_type_counts": 2,
    "latest_arrivals": 5,
    "airports_without_arrivals": 2,
    "status_by_airline": 10,
    "cancelled_flights": 312,
    "city_pair_models": 10,
    "delayed_pct_by_destination": 10,
    "kpis": 1,
    "status_distribution": 10,
    "top_airlines": 5,
    "facet_airlines": 10,
    "facet_statuses": 10,
    "facet_airports": 12,
    "explore_base": 602,
    "explore_table": 276,
    "explore_metrics": 1,
    "fleet_models": 10,
    "manufacturers": 8,
    "airport_list": 12,
    "airport_detail": 1,
    "delay_overview": 1,
    "delays_by_airport": 0,
    "airport_delays_daily": 3892,
}


@pytest.mark.parametrize("name", sorted(EXPECTED_SF0001))
def test_row_count_matches_fixture_notes(spark, small_sf, name):
    assert entry.queries()[name](spark, small_sf).count() == EXPECTED_SF0001[name]
