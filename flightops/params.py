"""Query parameters.

``REFERENCE`` holds the reference's own literals. ``FIXTURE`` holds the values used on
the driver tables, chosen so that every HAVING really filters there (the reference's
thresholds would keep every group of the fixture).
"""

# The reference's literals.
REFERENCE = {
    "busy_min_flights": 5,
    "outbound_min_flights": 5,
    "top_destinations_k": 3,
    "flight_type_limit": 20,          # 200 on the dashboard page
    "latest_arrivals_iata": "DEL",
    "latest_arrivals_k": 5,
    "city_pair_min_models": 2,
    "city_pair_k": 20,
    "top_airlines_k": 5,
    "explore_limit": 1000,
    "fleet_models_k": 10,
    "delays_min_flights": 10,
    "cancelled_status": "Canceled",
    "window_days_back": 3,
    "events_watermark": "1 hour",
    "dedup_delay": "3 days",
}

FIXTURE = dict(
    REFERENCE,
    busy_min_flights=30,
    outbound_min_flights=2000,
    flight_type_limit=200,
    latest_arrivals_iata="A05",
    city_pair_min_models=70,
    explore_airline="Supplier#000000006",
    explore_status="Arrived",
    airport_detail_iata="A05",
    delays_min_flights=2000,
    explore_since="1995-03-10",
    explore_until="1995-06-20",
    dedup_salt_buckets=4,    # ours, not the reference's: exercises the hot-key split
)
