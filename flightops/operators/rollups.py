"""A-9: the daily per-airport delay rollup the reference declares (``airport_delays``)
but never fills. The definition is ours: airport = origin IATA code, day = UTC date of
the scheduled departure (NULL is a group), delayed = delay_dep > 0, average and median
over the non-null departure delays, cancelled = the ``is_canceled`` flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops import schemas
from flightops.functions import expressions as X
from flightops.sources.sinks import merge_table


def airport_delays_daily(flights: DataFrame, exact_median: bool = True) -> DataFrame:
    """One row per (origin airport, day).

    The exact median keeps a value -> count map per group (merged map-side), so memory
    follows the distinct delay values of an airport-day (whole minutes, a few thousand at
    most), not its row count. ``exact_median=False`` uses ``percentile_approx``.
    """
    dep = F.col("delay_dep")
    median = F.median(dep) if exact_median else F.percentile_approx(dep, 0.5).cast("double")
    return (flights
            .groupBy(F.col("origin_iata").alias("airport_iata"),
                     F.to_date(F.col("scheduled_dep")).alias("delay_date"))
            .agg(F.count(F.lit(1)).alias("total_flights"),
                 X.sum_flag(dep > 0).alias("delayed_flights"),
                 F.avg(dep).alias("avg_delay_min"),
                 median.alias("median_delay_min"),
                 F.sum("is_canceled").cast("long").alias("canceled_flights")))


def publish_airport_delays(rollup: DataFrame, path: str, grain: str = "day",
                           days: DataFrame | None = None) -> None:
    """Store the rollup partitioned by day (``grain="day"``), or by ``delay_month``
    (``grain="month"``) for histories where a day holds only a handful of rows. Either way a
    rerun replaces exactly the days it holds; the month's other days stay. ``days``
    (delay_date) names all days that were computed again: one that has no flight any more loses its
    rows too (``versions`` does so by whole partitions). Read back with ``read_airport_delays``."""
    cols = [f.name for f in schemas.AIRPORT_DELAYS.fields]
    if grain == "day":
        merge_table(rollup.select(cols), path, "delay_date", owner=["delay_date"], owners=days)
    elif grain == "month":
        monthly = rollup.select(cols).withColumn(
            "delay_month", F.date_format(F.col("delay_date"), "yyyy-MM"))
        merge_table(monthly, path, "delay_month", owner=["delay_date"], owners=days)
    else:
        raise ValueError(f"grain must be 'day' or 'month', not {grain!r}")


def read_airport_delays(spark, path: str) -> DataFrame:
    cols = [f.name for f in schemas.AIRPORT_DELAYS.fields]
    return spark.read.parquet(path).select(cols)
