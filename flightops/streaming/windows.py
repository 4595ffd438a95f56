"""ST-1: 12-hour collection windows.

The reference polls every airport for the last N full days in two windows per day,
00:00-12:00 ("Morning") and 12:00-23:59 ("Evening"). Windows here are half-open,
[00:00, 12:00) and [12:00, 24:00): the reference's shared 12:00 instant and its lost last
evening minute are not reproduced (duplicates at 12:00 are ST-2's business).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.sources.landing import answered

# The two windows of a day, in poll order.
WINDOW_LABELS = ("Morning", "Evening")
WINDOW = "12 hours"


def window_label(start: Column) -> Column:
    return F.when(F.hour(start) < 12, F.lit(WINDOW_LABELS[0])).otherwise(F.lit(WINDOW_LABELS[1]))


def expected_windows(airports: DataFrame, last_day: Column, days_back: int = 3) -> DataFrame:
    """Every (airport, day, window) the poll should have covered: ``days_back`` days
    ending with ``last_day``. Generated per airport row (no cross join); the size is
    airports x days x 2, fixed by the parameters."""
    days = F.sequence(F.date_sub(last_day, days_back - 1), last_day)
    per_day = airports.select(F.col("iata_code").alias("airport_iata"),
                              F.explode(days).alias("window_date"))
    per_window = per_day.select("airport_iata", "window_date",
                                F.explode(F.array(*[F.lit(x) for x in WINDOW_LABELS])).alias("window_label"))
    start = F.timestamp_add("HOUR", F.when(F.col("window_label") == WINDOW_LABELS[0], 0).otherwise(12),
                            F.col("window_date").cast("timestamp_ntz"))
    return per_window.select("airport_iata", "window_date", "window_label",
                             start.alias("window_start"),
                             F.timestamp_add("HOUR", F.lit(12), start).alias("window_end"))


# The request window texts of a day, as the reference forms them.
WINDOW_FROM_TO = {"Morning": ("T00:00", "T12:00"), "Evening": ("T12:00", "T23:59")}


def poll_requests(airports: DataFrame, last_day: Column, days_back: int = 3) -> DataFrame:
    """The collection plan: one flight-service request per (airport, window), with the
    request's ``from``/``to`` texts. Windows run from ``last_day`` backwards, Morning
    before Evening, and ``window_idx`` is a window's position in that list (the landing
    format's ``window_idx``). 12 airports x 3 days gives the reference's 72 requests."""
    grid = expected_windows(airports, last_day, days_back)
    day_pos = F.datediff(last_day, F.col("window_date"))
    label_pos = F.when(F.col("window_label") == WINDOW_LABELS[0], 0).otherwise(1)
    day_text = F.date_format(F.col("window_date"), "yyyy-MM-dd")

    def part(i: int) -> Column:
        return F.when(F.col("window_label") == WINDOW_LABELS[0],
                      F.lit(WINDOW_FROM_TO[WINDOW_LABELS[0]][i])).otherwise(
            F.lit(WINDOW_FROM_TO[WINDOW_LABELS[1]][i]))

    return grid.select(
        "airport_iata", "window_date", "window_label",
        (day_pos * 2 + label_pos).alias("window_idx"),
        F.concat(day_text, part(0)).alias("window_from"),
        F.concat(day_text, part(1)).alias("window_to"))


def missing_windows(envelopes: DataFrame, airports: DataFrame, last_day: Column,
                    days_back: int = 3) -> DataFrame:
    """Requests of the poll (``days_back`` days ending with ``last_day``) without a landed
    answer. An answer without flights, or with arrivals only, is an answer; a malformed line
    is none. Only answers to windows of those days are read; they are reduced to distinct
    (airport, window) before the anti join."""
    grid = expected_windows(airports, last_day, days_back)
    start = F.when(F.col("window_label") == WINDOW_LABELS[0], WINDOW_FROM_TO[WINDOW_LABELS[0]][0]) \
        .otherwise(WINDOW_FROM_TO[WINDOW_LABELS[1]][0])
    grid = grid.withColumn("_from", F.concat(F.date_format("window_date", "yyyy-MM-dd"), start))
    since = F.date_format(F.date_sub(last_day, days_back - 1), "yyyy-MM-dd")
    landed = (envelopes.where((F.col("window_from") >= since) & answered())
              .select(F.col("airport").alias("airport_iata"), F.col("window_from").alias("_from"))
              .distinct())
    return (grid.join(landed, ["airport_iata", "_from"], "left_anti").drop("_from")
            .orderBy("airport_iata", "window_start"))


def event_window_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events per tumbling 12-hour window (batch form): events and distinct users.

    Counted per (window, user) first, then per window: two plain aggregations (the
    non-NULL user groups are the distinct users), no Expand."""
    w = F.window(F.col(ts), WINDOW)
    per_user = events.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return (per_user.groupBy("w")
            .agg(F.sum("n").cast("long").alias("n_events"), F.count("user_id").alias("n_users"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    window_label(F.col("w.start")).alias("window_label"), "n_events", "n_users"))


def stream_event_window_counts(spark: SparkSession, events_dir: str, file_glob: str,
                               sink_path: str, checkpoint_path: str,
                               watermark: str = "1 hour", schema=None) -> None:
    """Structured Streaming form: a file source over ``events_dir`` (files matching
    ``file_glob``), a watermark on the event time, tumbling 12-hour counts appended to a
    Parquet sink as windows close. Runs what is available and stops (availableNow);
    restarting with the same checkpoint continues exactly where it stopped.

    Counted per (window, user), then per window: two stateful aggregations in a row, so a
    hot window's users spread over all state tasks and distinct users are exact.
    ``event_windows_so_far`` adds the windows still open, ``late_events`` counts what came
    behind the watermark.

    The event time must be TIMESTAMP (not NTZ) for a watermark; with a UTC session the
    cast keeps the wall time."""
    source = (spark.readStream.format("parquet")
              .schema(schema or spark.read.option("pathGlobFilter", file_glob)
                      .parquet(events_dir).schema)
              .option("pathGlobFilter", file_glob)
              .load(events_dir))
    timed = source.withColumn("event_time", F.col("ts").cast("timestamp"))
    w = F.window(F.col("event_time"), WINDOW)
    per_user = (timed.withWatermark("event_time", watermark)
                .groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")))
    start = F.col("w.start").cast("timestamp_ntz")
    counts = (per_user.groupBy("w")
              .agg(F.sum("n").cast("long").alias("n_events"), F.count("user_id").alias("n_users"))
              .select(start.alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                      window_label(start).alias("window_label"), "n_events", "n_users"))
    query = (counts.writeStream.outputMode("append").format("parquet")
             .option("path", sink_path).option("checkpointLocation", checkpoint_path)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _closed_until(closed: DataFrame) -> Column:
    """End of the last closed window (a subquery of one value); the first time of all when
    none has closed."""
    return F.coalesce(closed.agg(F.max("window_end")).scalar(),
                      F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def event_windows_so_far(closed: DataFrame, events: DataFrame) -> DataFrame:
    """All windows: those the stream has closed, and those still open counted from the
    events after them (a filter on the event time, so the scan skips the closed past)."""
    tail = events.where(F.col("ts") >= _closed_until(closed))
    return closed.unionByName(event_window_counts(tail))


def late_events(closed: DataFrame, events: DataFrame) -> DataFrame:
    """Events of closed windows that came too late to be counted there (one row)."""
    past = events.where(F.col("ts") < _closed_until(closed)).agg(F.count(F.lit(1)).alias("n"))
    counted = closed.agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("n")).scalar()
    return past.select((F.col("n") - counted).cast("long").alias("late_events"))
