"""DuckDB oracle SQL for the registered queries.

Each statement is the flight-shaped fixture (FIXTURES.md section 3, DuckDB dialect) followed
by the report written from its definition, with the same parameters, tie-breaks and rounding as
the Spark plans but in a form of its own (subqueries, pre-aggregates, QUALIFY).
"""

from __future__ import annotations

from flightops import schemas
from flightops.params import FIXTURE as P
from flightops.plans.reports import STATUS_COUNT_COLUMNS
from flightops.sources.fixture import (AGAIN_FAILS, ASKED_AGAIN, BAD_TIME, BROKEN, DAMAGE_EVERY, FIRST_FAILS,
                                       NO_ARRAYS, RETRY_FAILS, RETRY_SECONDS, WRONG_TYPE)


def _addmin(minutes: str, ts: str) -> str:
    return f"({ts} + to_minutes(CAST({minutes} AS BIGINT)))"


FIXTURE_CTE = f"""
WITH
airports AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS icao_code,
         'A' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iata_code,
         n_name || ' Intl' AS name, n_name AS city, r_name AS country, r_name AS continent,
         CAST(n_nationkey AS DOUBLE) * 5 - 30 AS latitude, CAST(n_nationkey AS DOUBLE) * 10 - 60 AS longitude,
         'UTC' AS timezone
  FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey < 12),
raw AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity,
    CASE WHEN l_partkey % 29 = 28 THEN NULL
         ELSE 'FL ' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS flight_id,
    CASE WHEN s_suppkey % 23 = 0 THEN NULL ELSE 'S' || CAST(s_suppkey AS VARCHAR) END AS airline_code,
    CASE WHEN s_suppkey % 23 = 0 THEN NULL ELSE s_name END AS airline_name,
    CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN ''
         ELSE 'R-' || CAST(l_partkey AS VARCHAR) END AS aircraft_reg,
    CASE split_part(p_name, ' ', 1) WHEN 'blue' THEN 'Airbus' WHEN 'cold' THEN 'Boeing' WHEN 'hot' THEN 'ATR'
         WHEN 'large' THEN 'Embraer' WHEN 'new' THEN 'Bombardier' WHEN 'old' THEN 'De Havilland Canada'
         WHEN 'red' THEN 'McDonnell' ELSE 'Fokker' END || ' ' || p_brand AS aircraft_model,
    s_nationkey AS o_nat, CASE WHEN c_nationkey IN (7, 11) THEN NULL ELSE c_nationkey END AS d_nat,
    {_addmin("CAST(l_linenumber * 97 AS INT)", "o_orderdate")} AS t_dep,
    o_orderstatus || l_returnflag || l_linestatus AS code, l_returnflag || l_linestatus AS rl
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey),
timed AS (
  SELECT *, {_addmin("CAST(60 + l_partkey % 600 AS INT)", "t_dep")} AS t_arr,
    CASE code WHEN 'PAF' THEN 'Departed' WHEN 'PAO' THEN 'Expected' WHEN 'PNF' THEN 'Approaching'
      WHEN 'PNO' THEN 'Unknown' WHEN 'PRF' THEN 'Delayed' WHEN 'PRO' THEN 'Canceled'
      WHEN 'OAF' THEN 'CanceledUncertain' WHEN 'OAO' THEN 'EnRoute' WHEN 'ONF' THEN NULL ELSE 'Arrived' END AS status
  FROM raw),
flights AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity,
    flight_id, CASE WHEN flight_id IS NULL THEN '' ELSE split_part(flight_id, ' ', 2) END AS flight_number,
    airline_code, airline_name, aircraft_reg, aircraft_model,
    'A' || lpad(CAST(o_nat AS VARCHAR), 2, '0') AS origin_iata, 'N' || lpad(CAST(o_nat AS VARCHAR), 3, '0') AS origin_icao,
    'A' || lpad(CAST(d_nat AS VARCHAR), 2, '0') AS dest_iata, 'N' || lpad(CAST(d_nat AS VARCHAR), 3, '0') AS dest_icao,
    CASE WHEN code = 'ONF' THEN NULL ELSE t_arr END AS scheduled_arr,
    CASE WHEN rl = 'AO' THEN NULL ELSE {_addmin("CAST(l_quantity + (l_partkey % 40) - 45 AS INT)", "t_arr")} END AS actual_arr,
    CASE WHEN rl = 'AO' OR code = 'ONF' THEN NULL ELSE l_quantity + (l_partkey % 40) - 45 END AS delay_arr,
    CASE WHEN rl = 'NO' THEN NULL ELSE t_dep END AS scheduled_dep,
    CASE WHEN rl = 'RO' THEN NULL ELSE {_addmin("CAST(l_quantity - 25 AS INT)", "t_dep")} END AS actual_dep,
    CASE WHEN rl IN ('NO', 'RO') THEN NULL ELSE l_quantity - 25 END AS delay_dep,
    status, CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS is_cargo,
    CASE WHEN status IN ('Canceled', 'CanceledUncertain') THEN 1 ELSE 0 END AS is_canceled
  FROM timed),
aircraft AS (
  SELECT aircraft_reg, aircraft_model,
    CASE split_part(aircraft_model, ' ', 1) WHEN 'Airbus' THEN 'Airbus' WHEN 'Boeing' THEN 'Boeing' WHEN 'ATR' THEN 'ATR'
      WHEN 'Embraer' THEN 'Embraer' WHEN 'Bombardier' THEN 'Bombardier' WHEN 'De' THEN 'De Havilland'
      WHEN 'McDonnell' THEN 'McDonnell Douglas' END AS manufacturer,
    airline_name
  FROM (SELECT *, row_number() OVER (PARTITION BY aircraft_reg
          ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS rn
        FROM flights WHERE aircraft_reg IS NOT NULL AND aircraft_reg <> '') x
  WHERE rn = 1)
"""


def _round2(expr: str) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,12)), 2) AS DOUBLE)"


def _pct2(num: str, den: str) -> str:
    return _round2(f"CAST({num} AS DOUBLE) * 100.0 / NULLIF({den}, 0)")


def _flag(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


_LATE_ARRIVAL = "status IS NOT DISTINCT FROM 'Delayed' OR COALESCE(delay_arr, 0) > 0"

_FLIGHT_COLS = [
    ("flight_id", "string"), ("flight_number", "string"), ("airline_code", "string"),
    ("airline_name", "string"), ("aircraft_reg", "string"), ("aircraft_model", "string"),
    ("origin_iata", "string"), ("origin_icao", "string"), ("dest_iata", "string"),
    ("dest_icao", "string"), ("scheduled_arr", "timestamp_ntz"), ("actual_arr", "timestamp_ntz"),
    ("delay_arr", "double"), ("scheduled_dep", "timestamp_ntz"), ("actual_dep", "timestamp_ntz"),
    ("delay_dep", "double"), ("status", "string"), ("is_cargo", "int"), ("is_canceled", "int"),
]

def _top(c: str, pick: str) -> str:
    return (f"(SELECT {pick} FROM (SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM flights "
            f"WHERE {c} IS NOT NULL GROUP BY 1) t ORDER BY n DESC, v ASC LIMIT 1)")


_PROFILE = "\nUNION ALL\n".join(
    f"SELECT 'flights' AS table_name, '{c}' AS column_name, '{t}' AS data_type, "
    f"COUNT(*) AS row_count, COUNT({c}) AS non_null_count, COUNT(DISTINCT {c}) AS distinct_count, "
    f"{_top(c, 'v')} AS top_value, {_top(c, 'n')} AS top_count "
    f"FROM flights" for c, t in _FLIGHT_COLS)


def _audit_row(name: str, table: str, column: str, check: str, value_sql: str) -> str:
    return (f"SELECT '{name}' AS constraint_name, '{table}' AS table_name, '{column}' AS column_name, "
            f"'{check}' AS check_type, CAST(COALESCE(({value_sql}), 0) AS BIGINT) AS violations")


def _dups(table: str, col: str) -> str:
    return (f"SELECT COUNT(*) FROM (SELECT {col} FROM {table} WHERE {col} IS NOT NULL "
            f"GROUP BY {col} HAVING COUNT(*) > 1) t")


def _nulls(table: str, col: str) -> str:
    return f"SELECT COUNT(*) FROM {table} WHERE {col} IS NULL"


def _orphans(col: str, parent: str, pcol: str) -> str:
    return (f"SELECT COUNT(*) FROM flights f WHERE f.{col} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{pcol} = f.{col})")


_AUDIT = "\nUNION ALL\n".join([
    _audit_row("airports_icao_unique", "airports", "icao_code", "UNIQUE", _dups("airports", "icao_code")),
    _audit_row("airports_iata_unique", "airports", "iata_code", "UNIQUE", _dups("airports", "iata_code")),
    _audit_row("airports_iata_not_null", "airports", "iata_code", "NOT NULL", _nulls("airports", "iata_code")),
    _audit_row("aircraft_reg_unique", "aircraft", "aircraft_reg", "UNIQUE", _dups("aircraft", "aircraft_reg")),
    _audit_row("aircraft_reg_not_null", "aircraft", "aircraft_reg", "NOT NULL", _nulls("aircraft", "aircraft_reg")),
    _audit_row("flights_pk_unique", "flights", "flight_id", "PRIMARY KEY", _dups("flights", "flight_id")),
    _audit_row("flights_pk_not_null", "flights", "flight_id", "PRIMARY KEY", _nulls("flights", "flight_id")),
    _audit_row("flights_aircraft_fk", "flights", "aircraft_reg", "FOREIGN KEY",
               _orphans("aircraft_reg", "aircraft", "aircraft_reg")),
    _audit_row("flights_origin_fk", "flights", "origin_icao", "FOREIGN KEY",
               _orphans("origin_icao", "airports", "icao_code")),
    _audit_row("flights_dest_fk", "flights", "dest_icao", "FOREIGN KEY",
               _orphans("dest_icao", "airports", "icao_code")),
    _audit_row("airport_delays_airport_fk", "airport_delays", "airport_iata", "FOREIGN KEY",
               "SELECT COUNT(*) FROM (SELECT origin_iata AS airport_iata, CAST(scheduled_dep AS DATE) AS d "
               "FROM flights GROUP BY 1, 2) r WHERE r.airport_iata IS NOT NULL AND NOT EXISTS "
               "(SELECT 1 FROM airports p WHERE p.iata_code = r.airport_iata)"),
])

# Origin-destination pairs with at least one known end, how many flights they have, and
# what is known of the ends.
_ROUTES = """,
ends AS (SELECT origin_icao, dest_icao, COUNT(*) AS n FROM flights GROUP BY ALL),
routes AS (
  SELECT e.*, o.iata_code AS origin, o.country AS origin_country, d.iata_code AS destination,
         d.country AS dest_country,
         if(COALESCE(o.country = d.country, false), 'Domestic', 'International') AS flight_type
  FROM ends e LEFT JOIN airports o ON o.icao_code = e.origin_icao
              LEFT JOIN airports d ON d.icao_code = e.dest_icao
  WHERE EXISTS (FROM airports x WHERE x.icao_code = e.origin_icao OR x.icao_code = e.dest_icao))"""

_EXPLORED = f""",
explored AS (
  SELECT flight_number, f.airline_name, iata_code AS origin, city AS origin_city, scheduled_dep, status
  FROM airports JOIN (FROM flights WHERE airline_name = '{P['explore_airline']}') f
    ON icao_code = f.origin_icao)
"""

QUERIES_SQL: dict[str, str] = {
    "aircraft_dim": "SELECT aircraft_reg, aircraft_model, manufacturer, airline_name FROM aircraft",
    # Reports. Counts are taken per key of the fact first and named afterwards.
    "flights_per_model": """,
uses AS (SELECT aircraft_reg, COUNT(flight_id) AS n FROM flights GROUP BY ALL)
SELECT aircraft_model, SUM(n)::BIGINT AS total_flights
FROM uses JOIN aircraft USING (aircraft_reg) GROUP BY ALL""",
    "busy_aircraft": f""",
uses AS (SELECT aircraft_reg, COUNT(flight_id) AS n FROM flights GROUP BY ALL)
SELECT aircraft_reg AS registration, aircraft_model AS model, manufacturer, n AS flight_count
FROM uses JOIN aircraft USING (aircraft_reg) WHERE n > {P['busy_min_flights']}""",
    "outbound_airports": f""",
leaving AS (SELECT origin_icao AS icao_code, COUNT(flight_id) AS n FROM flights GROUP BY ALL)
SELECT name AS airport_name, city, country, n AS outbound_flights
FROM leaving JOIN airports USING (icao_code) WHERE n > {P['outbound_min_flights']}""",
    "top_destinations": f""",
landing AS (SELECT dest_icao AS icao_code, COUNT(flight_id) AS n FROM flights GROUP BY ALL)
SELECT name AS airport_name, city, country, n AS arriving_flights
FROM landing JOIN airports USING (icao_code)
QUALIFY row_number() OVER (ORDER BY n DESC, name NULLS LAST, city NULLS LAST, country NULLS LAST)
        <= {P['top_destinations_k']}""",
    "flight_type": _ROUTES + f"""
SELECT flight_number, origin, origin_country, destination, dest_country, flight_type
FROM flights f JOIN routes r ON f.origin_icao IS NOT DISTINCT FROM r.origin_icao
                            AND f.dest_icao IS NOT DISTINCT FROM r.dest_icao
QUALIFY row_number() OVER (ORDER BY flight_number NULLS LAST, origin NULLS LAST,
                           origin_country NULLS LAST, destination NULLS LAST,
                           dest_country NULLS LAST, flight_type) <= {P['flight_type_limit']}""",
    "flight_type_counts": _ROUTES + """
SELECT flight_type, SUM(n)::BIGINT AS flight_count FROM routes GROUP BY ALL""",
    "latest_arrivals": f""",
latest AS (
  SELECT * FROM flights
  WHERE dest_icao IN (SELECT icao_code FROM airports WHERE iata_code = '{P['latest_arrivals_iata']}')
  QUALIFY row_number() OVER (ORDER BY scheduled_arr DESC NULLS LAST, flight_number NULLS LAST,
                             aircraft_reg NULLS LAST, origin_icao NULLS LAST, actual_arr NULLS LAST,
                             status NULLS LAST) <= {P['latest_arrivals_k']})
SELECT flight_number,
       (SELECT x.aircraft_model FROM aircraft x WHERE x.aircraft_reg = l.aircraft_reg) AS aircraft,
       (SELECT x.manufacturer FROM aircraft x WHERE x.aircraft_reg = l.aircraft_reg) AS manufacturer,
       (SELECT x.name FROM airports x WHERE x.icao_code = l.origin_icao) AS departure_airport,
       (SELECT x.city FROM airports x WHERE x.icao_code = l.origin_icao) AS departure_city,
       actual_arr AS arrival_time, status
FROM latest l""",
    "airports_without_arrivals": """
SELECT iata_code, name AS airport_name, city, country FROM airports
WHERE icao_code NOT IN (SELECT dest_icao FROM flights WHERE dest_icao IS NOT NULL)""",
    "status_by_airline": """,
tally AS (SELECT airline_name, status, COUNT(*) AS n, COUNT(flight_id) AS numbered
          FROM flights GROUP BY ALL)
SELECT airline_name, """ + ", ".join(
        f"COALESCE(SUM(n) FILTER (status = '{value}'), 0)::BIGINT AS {name}"
        for name, value in STATUS_COUNT_COLUMNS) + """,
       SUM(numbered)::BIGINT AS total_flights
FROM tally GROUP BY ALL""",
    "cancelled_flights": """
SELECT flight_number, airline_name,
       (SELECT x.name FROM airports x WHERE x.icao_code = dest_icao) AS destination_airport,
       (SELECT x.city FROM airports x WHERE x.icao_code = dest_icao) AS destination_city,
       scheduled_dep AS scheduled_departure, status
FROM flights WHERE status IN ('Canceled')""",
    "city_pair_models": f""",
flown AS (SELECT DISTINCT f.origin_icao, f.dest_icao, x.aircraft_model
          FROM flights f JOIN aircraft x USING (aircraft_reg) WHERE x.aircraft_model IS NOT NULL),
models AS (SELECT DISTINCT o.city AS origin_city, d.city AS dest_city, o.iata_code AS origin_code,
                  d.iata_code AS dest_code, flown.aircraft_model
           FROM flown LEFT JOIN airports o ON o.icao_code = flown.origin_icao
                      LEFT JOIN airports d ON d.icao_code = flown.dest_icao),
pairs AS (SELECT origin_city, dest_city, origin_code, dest_code, COUNT(*) AS aircraft_model_count,
                 array_to_string(list_sort(list(aircraft_model)), ',') AS aircraft_models
          FROM models GROUP BY ALL)
SELECT * FROM pairs WHERE aircraft_model_count > {P['city_pair_min_models']}
QUALIFY row_number() OVER (ORDER BY aircraft_model_count DESC, origin_code NULLS LAST,
                           dest_code NULLS LAST, origin_city NULLS LAST, dest_city NULLS LAST)
        <= {P['city_pair_k']}""",
    "delayed_pct_by_destination": f""",
landing AS (SELECT dest_icao AS icao_code, COUNT(flight_id) AS n,
                   COUNT(*) FILTER ({_LATE_ARRIVAL}) AS late
            FROM flights GROUP BY ALL)
SELECT name AS airport_name, city, iata_code, n AS total_arrivals, late AS delayed_arrivals,
       {_pct2('late', 'n')} AS delay_percentage
FROM landing JOIN airports USING (icao_code) WHERE n > 0""",
    "kpis": """
SELECT total_flights, total_aircraft, total_airports, total_airlines
FROM (SELECT COUNT(*) AS total_flights, COUNT(DISTINCT airline_name) AS total_airlines FROM flights),
     (SELECT COUNT(*) AS total_aircraft FROM aircraft),
     (SELECT COUNT(*) AS total_airports FROM airports)""",
    "status_distribution": "SELECT status, COUNT(*) AS count FROM flights GROUP BY ALL",
    "top_airlines": f""",
sizes AS (SELECT airline_name, COUNT(*) AS flight_count FROM flights GROUP BY ALL)
SELECT * FROM sizes
QUALIFY row_number() OVER (ORDER BY flight_count DESC, airline_name NULLS LAST)
        <= {P['top_airlines_k']}""",
    "facet_airlines": "SELECT airline_name FROM flights GROUP BY ALL",
    "facet_statuses": "SELECT status FROM flights GROUP BY ALL",
    "facet_airports": "SELECT iata_code FROM airports GROUP BY ALL",
    "explore_base": _EXPLORED + "SELECT * FROM explored",
    "explore_table": _EXPLORED + f"""
SELECT * FROM explored WHERE status = '{P['explore_status']}'
QUALIFY row_number() OVER (ORDER BY scheduled_dep DESC NULLS LAST, flight_number NULLS LAST,
                           airline_name NULLS LAST, origin NULLS LAST, origin_city NULLS LAST,
                           status NULLS LAST) <= {P['explore_limit']}""",
    "explore_metrics": _EXPLORED + """,
counted AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (status = 'Canceled') AS c FROM explored)
SELECT n AS total_flights, c AS canceled_flights,
       CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE c::DOUBLE / n * 100.0 END AS canceled_pct
FROM counted""",
    "fleet_models": f""",
uses AS (SELECT aircraft_reg, airline_name AS airline, COUNT(flight_id) AS n
         FROM flights GROUP BY ALL),
models AS (SELECT aircraft_model, manufacturer, SUM(n)::BIGINT AS flight_count,
                  COUNT(DISTINCT airline) AS airlines_using
           FROM uses JOIN aircraft USING (aircraft_reg) GROUP BY ALL)
SELECT * FROM models
QUALIFY row_number() OVER (ORDER BY flight_count DESC, aircraft_model NULLS LAST,
                           manufacturer NULLS LAST) <= {P['fleet_models_k']}""",
    "manufacturers": "SELECT manufacturer, COUNT(*) AS aircraft_count FROM aircraft GROUP BY ALL",
    "airport_list": "SELECT iata_code, name, city FROM airports",
    "airport_detail": f"FROM airports WHERE iata_code = '{P['airport_detail_iata']}'",
    "delay_overview": f""",
late AS (SELECT delay_dep FROM flights WHERE delay_dep > 0)
SELECT (SELECT COUNT(*) FROM flights) AS total_flights, COUNT(*) AS delayed_flights,
       {_round2('AVG(delay_dep)')} AS avg_delay, (SELECT MAX(delay_dep) FROM flights) AS max_delay
FROM late""",
    "delays_by_airport": f""",
leaving AS (SELECT origin_icao AS icao_code, COUNT(flight_id) AS n,
                   COUNT(*) FILTER (delay_dep > 0) AS late, SUM(delay_dep) FILTER (delay_dep > 0) AS minutes
            FROM flights GROUP BY ALL),
named AS (SELECT name AS airport_name, iata_code, SUM(n)::BIGINT AS total_flights,
                 SUM(late)::BIGINT AS delayed_flights, SUM(minutes) AS minutes
          FROM leaving JOIN airports USING (icao_code) GROUP BY ALL)
SELECT airport_name, iata_code, total_flights, delayed_flights,
       {_round2('minutes / NULLIF(delayed_flights, 0)')} AS avg_delay,
       {_pct2('delayed_flights', 'total_flights')} AS delay_percentage
FROM named WHERE total_flights > {P['delays_min_flights']}""",
    "airport_delays_daily": f"""
SELECT origin_iata AS airport_iata, CAST(scheduled_dep AS DATE) AS delay_date,
       COUNT(*) AS total_flights, {_flag('delay_dep > 0')} AS delayed_flights,
       AVG(delay_dep) AS avg_delay_min, MEDIAN(delay_dep) AS median_delay_min,
       CAST(SUM(is_canceled) AS BIGINT) AS canceled_flights
FROM flights GROUP BY 1, 2""",
    "constraint_audit": _AUDIT,
    "airport_delays_published": None,
    "table_profile": _PROFILE,
}


_WINDOW_IDX = ("CAST(CASE WHEN scheduled_dep IS NULL THEN -1 ELSE "
               "date_diff('day', DATE '1970-01-01', CAST(scheduled_dep AS DATE)) * 2 "
               "+ CASE WHEN hour(scheduled_dep) >= 12 THEN 1 ELSE 0 END END AS INTEGER)")
_WINDOW_FROM = ("strftime(scheduled_dep, '%Y-%m-%d') || "
                "CASE WHEN hour(scheduled_dep) >= 12 THEN 'T12:00' ELSE 'T00:00' END")
_BUCKET = "time_bucket(INTERVAL 12 HOUR, ts)"

QUERIES_SQL.update({
    "ingest_flights": "SELECT " + ", ".join(c for c, _ in _FLIGHT_COLS) + " FROM flights",
    "landing_report": f"""
SELECT origin_iata AS airport, {_WINDOW_IDX} AS window_idx, {_WINDOW_FROM} AS window_from,
       COUNT(DISTINCT l_orderkey) AS answers, CAST(0 AS BIGINT) AS malformed,
       {_flag('l_linenumber % 2 = 1')} AS departures,
       {_flag('l_linenumber % 2 = 0')} AS arrivals
FROM flights GROUP BY 1, 2, 3""",
    "ingest_airports": """
SELECT icao_code, iata_code, name, city, country, continent, latitude, longitude, timezone
FROM airports""",
    "ingest_airports_csv": """
SELECT icao_code, iata_code, name, city, country, continent, latitude, longitude, timezone
FROM airports""",
    "missing_windows": f""",
bounds AS (SELECT CAST(MAX(scheduled_dep) AS DATE) AS last_day FROM flights),
days AS (SELECT CAST(unnest(generate_series(CAST(last_day - INTERVAL {P['window_days_back'] - 1} DAY AS DATE),
                                            last_day, INTERVAL 1 DAY)) AS DATE) AS window_date
         FROM bounds),
grid AS (SELECT a.iata_code AS airport_iata, d.window_date, l.window_label, l.h
         FROM airports a CROSS JOIN days d
         CROSS JOIN (VALUES ('Morning', 0), ('Evening', 12)) l(window_label, h)),
landed AS (SELECT DISTINCT origin_iata AS airport_iata, CAST(scheduled_dep AS DATE) AS window_date,
                  CASE WHEN hour(scheduled_dep) < 12 THEN 'Morning' ELSE 'Evening' END AS window_label
           FROM flights WHERE scheduled_dep IS NOT NULL)
SELECT g.airport_iata, g.window_date, g.window_label,
       CAST(g.window_date AS TIMESTAMP) + to_hours(g.h) AS window_start,
       CAST(g.window_date AS TIMESTAMP) + to_hours(g.h + 12) AS window_end
FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM landed x WHERE x.airport_iata = g.airport_iata
                  AND x.window_date = g.window_date AND x.window_label = g.window_label)""",
    "events_12h_windows": f"""
SELECT {_BUCKET} AS window_start, {_BUCKET} + INTERVAL 12 HOUR AS window_end,
       CASE WHEN hour({_BUCKET}) < 12 THEN 'Morning' ELSE 'Evening' END AS window_label,
       COUNT(*) AS n_events, COUNT(DISTINCT user_id) AS n_users
FROM events GROUP BY 1""",
    "stream_dedup_flights": """
SELECT DISTINCT flight_id, scheduled_dep, origin_icao, dest_icao, flight_number
FROM flights
WHERE flight_id IS NOT NULL AND scheduled_dep IS NOT NULL
  AND origin_icao IS NOT NULL AND dest_icao IS NOT NULL
UNION ALL
SELECT flight_id, scheduled_dep, origin_icao, dest_icao, flight_number
FROM (SELECT DISTINCT """ + ", ".join(schemas.FLIGHT_COLUMNS) + """ FROM flights
      WHERE flight_id IS NULL OR scheduled_dep IS NULL OR origin_icao IS NULL OR dest_icao IS NULL)""",
})


QUERIES_SQL["airport_delays_published"] = QUERIES_SQL["airport_delays_daily"]
QUERIES_SQL["reconcile_dedup_flights"] = QUERIES_SQL["stream_dedup_flights"]
QUERIES_SQL["landed_star_delayed_pct"] = QUERIES_SQL["delayed_pct_by_destination"]
QUERIES_SQL["poll_requests"] = f""",
bounds AS (SELECT CAST(MAX(scheduled_dep) AS DATE) AS last_day FROM flights),
days AS (SELECT CAST(unnest(generate_series(CAST(last_day - INTERVAL {P['window_days_back'] - 1} DAY AS DATE),
                                            last_day, INTERVAL 1 DAY)) AS DATE) AS window_date, last_day
         FROM bounds)
SELECT a.iata_code AS airport_iata, d.window_date, l.window_label,
       CAST(date_diff('day', d.window_date, d.last_day) * 2 + l.pos AS INTEGER) AS window_idx,
       strftime(d.window_date, '%Y-%m-%d') || l.t_from AS window_from,
       strftime(d.window_date, '%Y-%m-%d') || l.t_to AS window_to
FROM airports a CROSS JOIN days d
CROSS JOIN (VALUES ('Morning', 0, 'T00:00', 'T12:00'), ('Evening', 1, 'T12:00', 'T23:59'))
     l(window_label, pos, t_from, t_to)"""
QUERIES_SQL["landing_totals"] = f"""
SELECT airport, CAST(SUM(answers) AS BIGINT) AS answers, CAST(0 AS BIGINT) AS malformed,
       CAST(SUM(n) AS BIGINT) AS flights
FROM (SELECT origin_iata AS airport, {_WINDOW_IDX} AS window_idx,
             COUNT(DISTINCT l_orderkey) AS answers, COUNT(*) AS n
      FROM flights GROUP BY 1, 2) t
GROUP BY airport"""


QUERIES_SQL["events_12h_windows_stream"] = QUERIES_SQL["events_12h_windows"]
QUERIES_SQL["incremental_publish"] = QUERIES_SQL["ingest_flights"]
QUERIES_SQL["incremental_airports"] = QUERIES_SQL["ingest_airports"]
QUERIES_SQL["incremental_delays"] = QUERIES_SQL["airport_delays_daily"]
# every call of the fixture's polls, and whether it succeeds
_CALLS = f""",
asked AS (SELECT origin_iata AS airport, {_WINDOW_IDX} AS window_idx, COUNT(*) AS n,
                 {_WINDOW_IDX} * 12 + CAST(substr(origin_iata, 2) AS INTEGER) AS k
          FROM flights WHERE scheduled_dep IS NOT NULL GROUP BY 1, 2),
calls AS (SELECT *, 0 AS days, 0 AS seconds, 1 AS attempt, k % {FIRST_FAILS} <> 0 AS ok FROM asked
          UNION ALL SELECT *, 0, {RETRY_SECONDS}, 2, k % {RETRY_FAILS} <> 0 FROM asked WHERE k % {FIRST_FAILS} = 0
          UNION ALL SELECT *, 1, 0, 1, k % {AGAIN_FAILS} <> 0 FROM asked WHERE k % {ASKED_AGAIN} = 0),
dated AS (SELECT *, CAST(DATE '1970-01-01' + window_idx // 2 AS DATE) AS day,
                 CAST(DATE '1970-01-01' + (window_idx // 2 + 1 + days) AS DATE) AS poll_day FROM calls)"""
QUERIES_SQL["poll_report"] = _CALLS + """,
per_request AS (SELECT poll_day, airport, window_idx, COUNT(*) AS calls, COUNT(*) FILTER (ok) AS answers,
                       COUNT(*) FILTER (attempt > 1) AS retries, SUM(n) FILTER (ok) AS n
                FROM dated GROUP BY ALL)
SELECT strftime(poll_day, '%Y-%m-%d') AS poll, SUM(calls)::BIGINT AS calls, SUM(answers)::BIGINT AS answers,
       (SUM(calls) - SUM(answers))::BIGINT AS errors, SUM(retries)::BIGINT AS retries,
       COUNT(*) FILTER (answers = 0) AS unanswered_requests, COALESCE(SUM(n), 0)::BIGINT AS flights
FROM per_request GROUP BY poll_day"""
QUERIES_SQL["unanswered_calls"] = _CALLS + """
SELECT strftime(poll_day, '%Y-%m-%d') AS poll, airport, window_idx,
       strftime(day, '%Y-%m-%d') || CASE WHEN window_idx % 2 = 1 THEN 'T12:00' ELSE 'T00:00' END AS window_from,
       strftime(day, '%Y-%m-%d') || CASE WHEN window_idx % 2 = 1 THEN 'T23:59' ELSE 'T12:00' END AS window_to,
       attempt, CAST(poll_day AS TIMESTAMP) + INTERVAL 6 HOUR + to_seconds(seconds) AS requested_at
FROM dated WHERE NOT ok"""
QUERIES_SQL["unanswered_calls_stream"] = QUERIES_SQL["unanswered_calls"]
QUERIES_SQL["restore_flights"] = QUERIES_SQL["ingest_flights"]
QUERIES_SQL["distinct_by_quarter"] = """
SELECT year(scheduled_dep) || '-Q' || quarter(scheduled_dep) AS quarter, COUNT(*) AS n_flights,
       COUNT(DISTINCT airline_name) AS n_airlines, COUNT(DISTINCT NULLIF(aircraft_reg, '')) AS n_aircraft,
       COUNT(DISTINCT aircraft_model) AS n_models,
       TRUE AS n_airlines_near, TRUE AS n_aircraft_near, TRUE AS n_models_near
FROM flights WHERE scheduled_dep IS NOT NULL GROUP BY 1"""
QUERIES_SQL["late_events"] = """,
span AS (SELECT CAST(MIN(ts) AS DATE) AS first_day, CAST(MAX(ts) AS DATE) AS last_day FROM events)
SELECT COUNT(*) AS late_events FROM events, span
WHERE ts < CAST(first_day + CAST(date_diff('day', first_day, last_day) // 2 AS INTEGER) AS TIMESTAMP)"""
QUERIES_SQL["explore_clustered"] = QUERIES_SQL["explore_table"]
QUERIES_SQL["quarantine_counts"] = f"""
SELECT * FROM ({_AUDIT}) WHERE violations > 0"""
QUERIES_SQL["restore_long_lists"] = QUERIES_SQL["ingest_flights"]
QUERIES_SQL["cancelled_flights_csv"] = f"""
SELECT NULLIF(flight_number, '') AS flight_number, * EXCLUDE (flight_number)
FROM ({QUERIES_SQL["cancelled_flights"]})"""
QUERIES_SQL["explore_days"] = f"""
SELECT flight_number, airline_name, iata_code AS origin, city AS origin_city, scheduled_dep, status
FROM flights JOIN airports ON icao_code = origin_icao
WHERE scheduled_dep >= DATE '{P['explore_since']}' AND scheduled_dep < DATE '{P['explore_until']}' + INTERVAL 1 DAY"""
# first sight: airport, window, departures (odd lines) before arrivals, place in the answer
QUERIES_SQL["landed_aircraft_dim"] = f""",
placed AS (SELECT *, {_WINDOW_IDX} AS window_idx, l_linenumber % 2 = 0 AS arrival,
                  row_number() OVER (PARTITION BY l_orderkey, origin_iata, {_WINDOW_IDX}, l_linenumber % 2
                                     ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS pos
           FROM flights),
seen AS (SELECT aircraft_reg, aircraft_model, airline_name FROM placed
         WHERE aircraft_reg <> ''
         QUALIFY row_number() OVER (PARTITION BY aircraft_reg
           ORDER BY origin_iata, window_idx, arrival, pos, aircraft_model NULLS FIRST, airline_name NULLS FIRST) = 1)
SELECT seen.aircraft_reg, seen.aircraft_model, manufacturer, seen.airline_name
FROM seen JOIN (SELECT DISTINCT aircraft_model, manufacturer FROM aircraft) USING (aircraft_model)"""
_TIMES = "COALESCE(scheduled_dep, actual_dep, scheduled_arr, actual_arr)"
_LOADS = f"l_orderkey % {DAMAGE_EVERY} NOT IN ({BROKEN}, {NO_ARRAYS})"
QUERIES_SQL["landing_rejects"] = f""",
landed AS (SELECT *, l_orderkey % {DAMAGE_EVERY} AS kind, {_LOADS} AS loads,
                  CASE WHEN l_orderkey % {DAMAGE_EVERY} <> {BROKEN} THEN origin_iata END AS airport,
                  l_orderkey::VARCHAR || ' ' || origin_iata || ' ' || {_WINDOW_IDX}::VARCHAR AS line
           FROM flights)
SELECT airport, COUNT(DISTINCT line) AS lines,
       COUNT(DISTINCT line) FILTER (kind = {BROKEN}) AS broken_lines,
       COUNT(DISTINCT line) FILTER (kind = {WRONG_TYPE}) AS wrong_typed,
       COUNT(DISTINCT line) FILTER (kind <> {BROKEN} AND (kind = {WRONG_TYPE} OR scheduled_dep IS NULL)) AS no_window,
       COUNT(DISTINCT line) FILTER (kind = {NO_ARRAYS}) AS without_flights,
       COUNT(*) FILTER (loads) AS flights,
       COUNT(*) FILTER (kind = {BAD_TIME} AND {_TIMES} IS NOT NULL) AS bad_times,
       COUNT(*) FILTER (loads AND flight_id IS NULL) AS no_number,
       0::BIGINT AS no_aircraft, 0::BIGINT AS no_airline
FROM landed GROUP BY airport"""


def oracle_sql() -> dict[str, str]:
    return {name: FIXTURE_CTE + sql for name, sql in QUERIES_SQL.items()}
