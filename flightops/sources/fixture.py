"""Flight-shaped star schema derived from the driver's TPC-H-like tables.

This is the stand-in for landed flight-service data when testing and benchmarking: 12 of
the 25 nations are the polled "airports", lineitems are flights. The mapping is the one
written down in FIXTURES.md section 3 (the DuckDB oracle uses the same text), so every
report can be checked row for row.

All of it is lazy DataFrame code: the joins are planned by Catalyst / AQE (shuffle joins
for lineitem-orders-part-customer at scale, broadcast for tiny sides at runtime).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops import schemas
from flightops.functions import expressions as X
from flightops.operators import joins

# Fixed values of the fixture mapping (FIXTURES.md section 3).
FIXTURE_AIRPORT_COUNT = 12
NEVER_DESTINATION_NATIONS = (7, 11)
# first word of p_name -> maker prefix of the aircraft model
MODEL_MAKER_BY_PART_WORD = {
    "blue": "Airbus",
    "cold": "Boeing",
    "hot": "ATR",
    "large": "Embraer",
    "new": "Bombardier",
    "old": "De Havilland Canada",
    "red": "McDonnell",
}
OTHER_MAKER = "Fokker"
# o_orderstatus || l_returnflag || l_linestatus -> flight status; anything else 'Arrived'
STATUS_BY_CODE = {
    "PAF": "Departed",
    "PAO": "Expected",
    "PNF": "Approaching",
    "PNO": "Unknown",
    "PRF": "Delayed",
    "PRO": "Canceled",
    "OAF": "CanceledUncertain",
    "OAO": "EnRoute",
    "ONF": None,
}
DEFAULT_STATUS = "Arrived"
# order of first sight inside the fixture (unique together with l_partkey, which is
# constant inside one registration)
SEEN_ORDER_KEYS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def _case(subject: Column, mapping: dict, default) -> Column:
    expr = None
    for key, value in mapping.items():
        lit_value = F.lit(value) if value is not None else F.lit(None).cast("string")
        expr = (F.when(subject == key, lit_value) if expr is None
                else expr.when(subject == key, lit_value))
    return expr.otherwise(F.lit(default) if default is not None else F.lit(None).cast("string"))


def _add_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), ts)


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The airports dimension: nations 0..11 with their region as country."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return (
        nation.where(key < FIXTURE_AIRPORT_COUNT)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _code("N", key, 3).alias("icao_code"),
            _code("A", key, 2).alias("iata_code"),
            F.concat(F.col("n_name"), F.lit(" Intl")).alias("name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
            F.col("r_name").alias("continent"),
            (key.cast("double") * 5 - 30).alias("latitude"),
            (key.cast("double") * 10 - 60).alias("longitude"),
            F.lit("UTC").alias("timezone"),
        )
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flights fact: one row per lineitem, the 19 reported columns plus
    ``seen_order`` (first-seen order) and ``flight_date`` (UTC date of scheduled_dep)."""
    # Hash-partition lineitem on the first join key: at scale this is the exchange the
    # lineitem-orders sort-merge join needs anyway (no extra shuffle); when orders is small
    # enough to broadcast it still spreads an input that arrives as one row group over all
    # cores. No count is given: AQE then cuts partitions by their bytes, so that no task's
    # sort grows with the tables.
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice",
        "l_quantity", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    # what follows from a part or a supplier alone is made there, once a part, not once a flight
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(_case(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)),
                       MODEL_MAKER_BY_PART_WORD, OTHER_MAKER),
                 F.lit(" "), F.col("p_brand")).alias("aircraft_model"))
    no_supplier, o_nat = F.col("s_suppkey") % 23 == 0, F.col("s_nationkey")
    supplier = read_table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(no_supplier, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("airline_code"),
        F.when(no_supplier, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("airline_name"),
        _code("A", o_nat, 2).alias("origin_iata"), _code("N", o_nat, 3).alias("origin_icao"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")

    # Join order is written by hand (cost-based reordering is off by default): customer
    # only adds the destination nation at order grain, so it meets orders first and the
    # fact is shuffled once for orders and once for part, not a third time for customer.
    # Supplier is broadcast as far as its size allows; by its key the fact would be shuffled again.
    order_side = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        li.join(order_side, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(joins.sized_broadcast(supplier), F.col("l_suppkey") == F.col("s_suppkey"))
    )

    partkey, qty = F.col("l_partkey"), F.col("l_quantity")
    raw = joined.select(
        *[F.col(k) for k in SEEN_ORDER_KEYS],
        F.when(partkey % 29 == 28, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("FL "), F.col("l_orderkey").cast("string"), F.lit("-"),
                            F.col("l_linenumber").cast("string"))).alias("flight_id"),
        "airline_code", "airline_name", "origin_iata", "origin_icao",
        F.when(partkey % 17 == 0, F.lit(None).cast("string"))
        .when(partkey % 19 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("R-"), partkey.cast("string"))).alias("aircraft_reg"),
        "aircraft_model",
        F.when(F.col("c_nationkey").isin(list(NEVER_DESTINATION_NATIONS)), F.lit(None).cast("int"))
        .otherwise(F.col("c_nationkey")).alias("d_nat"),
        _add_minutes(F.col("o_orderdate"), F.col("l_linenumber") * 97).alias("t_dep"),
        F.concat(F.col("o_orderstatus"), F.col("l_returnflag"), F.col("l_linestatus")).alias("code"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("rl"),
        partkey,
    )

    code, rl, t_dep = F.col("code"), F.col("rl"), F.col("t_dep")
    t_arr = _add_minutes(t_dep, 60 + partkey % 600)
    arr_shift = qty + partkey % 40 - 45
    dep_shift = qty - 25
    null_ts = F.lit(None).cast("timestamp_ntz")
    null_d = F.lit(None).cast("double")
    status = _case(code, STATUS_BY_CODE, DEFAULT_STATUS)

    out = raw.select(
        F.struct(*[F.col(k) for k in SEEN_ORDER_KEYS]).alias(schemas.SEEN_ORDER),
        F.col("flight_id"),
        X.flight_number("flight_id").alias("flight_number"),
        "airline_code", "airline_name", "aircraft_reg", "aircraft_model",
        "origin_iata", "origin_icao",
        _code("A", F.col("d_nat"), 2).alias("dest_iata"),
        _code("N", F.col("d_nat"), 3).alias("dest_icao"),
        F.when(code == "ONF", null_ts).otherwise(t_arr).alias("scheduled_arr"),
        F.when(rl == "AO", null_ts).otherwise(_add_minutes(t_arr, arr_shift)).alias("actual_arr"),
        F.when((rl == "AO") | (code == "ONF"), null_d).otherwise(arr_shift.cast("double")).alias("delay_arr"),
        F.when(rl == "NO", null_ts).otherwise(t_dep).alias("scheduled_dep"),
        F.when(rl == "RO", null_ts).otherwise(_add_minutes(t_dep, dep_shift)).alias("actual_dep"),
        F.when(rl.isin("NO", "RO"), null_d).otherwise(dep_shift.cast("double")).alias("delay_dep"),
        status.alias("status"),
        F.when(partkey % 13 == 0, F.lit(1)).otherwise(F.lit(0)).alias("is_cargo"),
        X.in_flag(status, X.CANCELED_STATUSES).cast("int").alias("is_canceled"),
    )
    return out.withColumn(schemas.FLIGHT_DATE, F.to_date(F.col("scheduled_dep")))


# ----------------------------------------------------------------- landed JSON fixtures

def _utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm'Z'")


def _endpoint_doc(iata: str, icao: str, scheduled: str, revised: str) -> Column:
    return F.struct(
        F.struct(F.col(iata).alias("iata"), F.col(icao).alias("icao")).alias("airport"),
        F.struct(_utc_text(F.col(scheduled)).alias("utc")).alias("scheduledTime"),
        F.struct(_utc_text(F.col(revised)).alias("utc")).alias("revisedTime"))


def flight_doc(flights: DataFrame) -> Column:
    """The flight-service document of a flights row (inverse of the S-2 flatten).
    ``isCargo`` is left out (NULL) on some non-cargo rows, which must read as false."""
    line = F.col(f"{schemas.SEEN_ORDER}.l_linenumber")
    is_cargo = (F.when(F.col("is_cargo") == 1, F.lit(True))
                .when(line % 2 == 0, F.lit(None).cast("boolean"))
                .otherwise(F.lit(False)))
    return F.struct(
        F.col("flight_id").alias("number"),
        F.col("status").alias("status"),
        is_cargo.alias("isCargo"),
        F.struct(F.col("aircraft_reg").alias("reg"), F.col("aircraft_model").alias("model"),
                 F.lit(None).cast("string").alias("modeS")).alias("aircraft"),
        F.struct(F.col("airline_code").alias("iata"), F.col("airline_name").alias("name"),
                 F.lit(None).cast("string").alias("icao")).alias("airline"),
        _endpoint_doc("origin_iata", "origin_icao", "scheduled_dep", "actual_dep").alias("departure"),
        _endpoint_doc("dest_iata", "dest_icao", "scheduled_arr", "actual_arr").alias("arrival"),
    )


#: Columns of a flight that its document is made of.
_DOC_COLUMNS = ["flight_id", "status", "is_cargo", "aircraft_reg", "aircraft_model", "airline_code", "airline_name",
                "origin_iata", "origin_icao", "scheduled_dep", "actual_dep",
                "dest_iata", "dest_icao", "scheduled_arr", "actual_arr"]


def _by_order(flights: DataFrame) -> DataFrame:
    """Flights dealt by order (``chunk``), so that groups within an order need no further exchange."""
    return flights.withColumn("chunk", F.col(f"{schemas.SEEN_ORDER}.l_orderkey")).repartition("chunk")


def by_turns(flights: DataFrame, turns: int) -> list[DataFrame]:
    """All flights in ``turns`` sets, each holding whole orders: what is made of orders can be written set
    by set, and only one set's exchange is held at a time."""
    turn = F.pmod(F.xxhash64(F.col(f"{schemas.SEEN_ORDER}.l_orderkey")), F.lit(turns))
    return [flights] if turns == 1 else [flights.where(turn == k) for k in range(turns)]


def half_day_index(ts: Column) -> Column:
    """12-hour window of a time: 2 * days since 1970-01-01 (+1 from noon); NULL -> -1."""
    idx = (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 2
           + (F.hour(ts) >= 12).cast("int"))
    return F.coalesce(idx, F.lit(-1))


def landed_envelopes(flights: DataFrame, both_ends: bool = False) -> DataFrame:
    """Landed envelope rows (LANDED_ENVELOPE layout) built from a flights table.

    Single mode: every flight lands once, at its origin, as a departure (odd line
    numbers) or an arrival (even ones), so the landed set equals the table.
    ``both_ends``: every flight lands as a departure at its origin and again as an
    arrival at its destination, which is how the polled service duplicates flights.
    One envelope per (airport, 12-hour window, order): at most seven flights, so no
    envelope grows with the data; an envelope without departures or arrivals has that
    array missing.

    Flights are dealt by order as plain columns, each once; documents, which are some
    times as long, are made after that and meet in envelopes without another exchange.
    """
    return _envelopes(flights, both_ends).drop("chunk")


def _envelopes(flights: DataFrame, both_ends: bool = False) -> DataFrame:
    """``landed_envelopes`` with the order that each envelope comes from (``chunk``)."""
    flights = _by_order(flights.select(schemas.SEEN_ORDER, *_DOC_COLUMNS))
    doc = flight_doc(flights)
    line = F.col(f"{schemas.SEEN_ORDER}.l_linenumber")
    window = half_day_index(F.col("scheduled_dep"))
    if both_ends:
        # told apart after the exchange: two branches would each need their own
        ends = F.when(F.col("dest_iata").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        flights = flights.withColumn("dir", F.explode(ends))
        airport, direction = F.when(F.col("dir") == 0, F.col("origin_iata")).otherwise(F.col("dest_iata")), F.col("dir")
    else:
        airport, direction = F.col("origin_iata"), F.when(line % 2 == 1, F.lit(0)).otherwise(F.lit(1))
    legs = flights.select("chunk", F.col(schemas.SEEN_ORDER).alias("seen"), doc.alias("doc"), window.alias("window_idx"),
                          airport.alias("airport"), direction.alias("dir"))

    def side(d: int) -> Column:
        items = F.collect_list(F.when(F.col("dir") == d, F.struct("seen", "doc")))
        ordered = F.transform(F.sort_array(items), lambda x: x["doc"])
        return F.when(F.size(ordered) > 0, ordered)

    env = legs.groupBy("airport", "window_idx", "chunk").agg(
        side(0).alias("departures"), side(1).alias("arrivals"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("window_idx") / 2).cast("int"))
    evening = F.col("window_idx") % 2 == 1
    known = F.col("window_idx") >= 0
    return env.select(
        "chunk", "airport", "window_idx",
        F.when(known, F.concat(day.cast("string"),
                               F.when(evening, F.lit("T12:00")).otherwise(F.lit("T00:00")))).alias("window_from"),
        F.when(known, F.concat(day.cast("string"),
                               F.when(evening, F.lit("T23:59")).otherwise(F.lit("T12:00")))).alias("window_to"),
        "departures", "arrivals")


# ----------------------------------------------------------------- polls over the landing

#: A request's calls by its number (12 * window + airport): the first attempt fails where the first
#: divides it, the retry where the second does too; the next day's poll asks again where the third
#: does, and fails where the fourth does.
FIRST_FAILS, RETRY_FAILS, ASKED_AGAIN, AGAIN_FAILS = 5, 25, 3, 7
ANSWER_SECONDS, RETRY_SECONDS = 5, 60


def poll_calls(envelopes: DataFrame) -> DataFrame:
    """The journal of daily polls over the windows of a landing, and whether each call succeeds
    (``ok``): a window is asked for at six the day after, and partly again a day later."""
    windows = envelopes.where("window_idx >= 0").select("airport", "window_idx", "window_from", "window_to").distinct()
    number = F.col("window_idx") * FIXTURE_AIRPORT_COUNT + F.substring("airport", 2, 2).cast("int")

    def attempt(days: int, seconds: int, which: int, ok: Column) -> Column:
        return F.struct(F.lit(days).alias("days"), F.lit(seconds).alias("seconds"), F.lit(which).alias("attempt"), ok.alias("ok"))
    calls = F.array(
        attempt(0, 0, 1, number % FIRST_FAILS != 0),
        F.when(number % FIRST_FAILS == 0, attempt(0, RETRY_SECONDS, 2, number % RETRY_FAILS != 0)),
        F.when(number % ASKED_AGAIN == 0, attempt(1, 0, 1, number % AGAIN_FAILS != 0)))
    each = windows.withColumn("c", F.explode(F.filter(calls, lambda c: c.isNotNull())))
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(F.col("window_idx") / 2) + 1 + F.col("c.days")).cast("int"))
    at = F.timestamp_add("SECOND", F.col("c.seconds"), F.timestamp_add("HOUR", F.lit(6), day.cast("timestamp_ntz")))
    return each.select(day.cast("string").alias("poll"), "airport", "window_idx", "window_from", "window_to",
                       "c.attempt", at.alias("requested_at"), "c.ok")


def polled_answers(envelopes: DataFrame, calls: DataFrame) -> DataFrame:
    """The answers of all calls that succeed: the request's envelopes, with flight numbers alone."""
    def slim(side: str) -> Column:
        return F.transform(side, lambda f: F.struct(f["number"].alias("number")))
    slim_lines = envelopes.select("airport", "window_idx", slim("departures").alias("departures"), slim("arrivals").alias("arrivals"))
    at = F.timestamp_add("SECOND", F.lit(ANSWER_SECONDS), F.col("requested_at"))
    return (calls.where("ok").join(slim_lines, ["airport", "window_idx"])
            .select("airport", "window_idx", "window_from", "window_to",
                    F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("answered_at"), "departures", "arrivals"))


#: What damages a line, by l_orderkey % DAMAGE_EVERY; other lines stay whole.
DAMAGE_EVERY = 7
BROKEN, WRONG_TYPE, BAD_TIME, NO_ARRAYS = 1, 2, 3, 4


def damaged_landing(flights: DataFrame) -> DataFrame:
    """Landed lines (a text column) of all flights, some of them cut off, with a field of the
    wrong type, with times in another form, or with neither array."""
    line = F.col("value")
    damage = {BROKEN: F.substring(line, F.lit(1), F.length(line) - 5),
              WRONG_TYPE: F.regexp_replace(line, '"window_idx":(-?[0-9]+)', '"window_idx":"no $1"'),
              BAD_TIME: F.regexp_replace(line, '([0-9]{2}):([0-9]{2})Z"', '$1h$2"'),
              NO_ARRAYS: F.regexp_replace(line, '"(departures|arrivals)":', '"no_$1":')}
    # an envelope holds flights of one order, so its order tells what damages it
    envelopes = _envelopes(flights)
    kind = F.col("chunk") % DAMAGE_EVERY
    fields = [F.col(c) for c in envelopes.columns if c != "chunk"]
    lines = envelopes.where(kind.isNotNull()).select(kind.alias("kind"), F.to_json(F.struct(*fields)).alias("value"))
    damaged = line
    for k, change in damage.items():
        damaged = F.when(F.col("kind") == k, change).otherwise(damaged)
    return lines.select(damaged.alias("value"))


LIST_ORDERS = 4096  # order numbers of one saved list: some 16,000 flights


def _list_part() -> Column:
    return F.floor(F.col(f"{schemas.SEEN_ORDER}.l_orderkey") / LIST_ORDERS)


def _gathered(flights: DataFrame, by: list[str]) -> DataFrame:
    """Flights as JSON texts joined by commas (``items``), in order, one row for each ``by``."""
    # each document is written once, on its own: lists of texts are lighter to hold and sort than of structs
    text = F.to_json(flight_doc(flights))
    docs = flights.select(*by, F.struct(F.col(schemas.SEEN_ORDER).alias("seen"), text.alias("doc")).alias("f"))
    items = F.transform(F.sort_array(F.collect_list("f")), lambda x: x["doc"])
    return docs.groupBy(*by).agg(F.array_join(items, ",").alias("items"))


def saved_lists(flights: DataFrame) -> DataFrame:
    """Flights as JSON lists (a text column), one for each range of order numbers, so that no
    list grows with the data; written one row a file they are saved whole-file lists.

    Flights are dealt by list as plain columns; documents, which are some times as long, are
    made after that and meet in lists without another exchange."""
    flights = flights.select(schemas.SEEN_ORDER, *_DOC_COLUMNS).withColumn("part", _list_part()).repartition("part")
    return _gathered(flights, ["part"]).select(F.concat(F.lit("["), F.col("items"), F.lit("]")).alias("value"))


LONG_LIST_PARTS = 64  # such ranges of one long list: some million flights a file


def write_long_lists(flights: DataFrame, path: str, turns: int = 1) -> None:
    """Flights as long JSON lists, one a file, each written piece by piece in order, in ``turns`` of whole
    lists. Flights are dealt by list as plain columns and sorted there: a task holds the texts of one piece
    at a time, which the sort-based aggregation does, and no text is exchanged."""
    flights = (flights.select(schemas.SEEN_ORDER, *_DOC_COLUMNS).withColumn("part", _list_part())
               .withColumn("list", F.floor(F.col("part") / LONG_LIST_PARTS)))
    ends = F.broadcast(flights.groupBy(F.col("list").alias("_list")).agg(F.min("part").alias("_first"), F.max("part").alias("_last")))
    turn = F.coalesce(F.pmod(F.col("list"), F.lit(turns)), F.lit(0))
    conf, by_hash = flights.sparkSession.conf, "spark.sql.execution.useObjectHashAggregateExec"
    before = conf.get(by_hash)
    conf.set(by_hash, "false")
    try:
        for k in range(turns):
            dealt = flights.where(turn == k).repartition("list").sortWithinPartitions("list", "part", schemas.SEEN_ORDER)
            pieces = _gathered(dealt, ["list", "part"]).join(ends, F.col("list").eqNullSafe(F.col("_list")))
            head = F.when(F.col("part").eqNullSafe(F.col("_first")), "[").otherwise(",")
            tail = F.when(F.col("part").eqNullSafe(F.col("_last")), "]").otherwise("")
            pieces.select("list", F.concat(head, "items", tail).alias("value")).write.mode("append").partitionBy("list").text(path)
    finally:
        conf.set(by_hash, before)


def airport_docs(airports_df: DataFrame) -> DataFrame:
    """Airport documents as the service returns them; even-numbered codes carry an empty
    shortName so the name must fall back to fullName."""
    even = F.substring(F.col("iata_code"), -1, 1).cast("int") % 2 == 0
    return airports_df.select(
        F.col("icao_code").alias("icao"), F.col("iata_code").alias("iata"),
        F.when(even, F.lit("")).otherwise(F.col("name")).alias("shortName"),
        F.col("name").alias("fullName"),
        F.col("city").alias("municipalityName"),
        F.struct(F.col("country").alias("name")).alias("country"),
        F.struct(F.col("continent").alias("name")).alias("continent"),
        F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("location"),
        F.col("timezone").alias("timeZone"))
