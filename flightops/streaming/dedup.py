"""ST-2: incremental ingest of landed envelopes with de-duplication.

The reference polls airports x windows in a loop and appends everything it gets, so a
flight arrives several times: as a departure of one polled airport and an arrival of
another, and again at the shared 12:00 window edge. Here the landing folder is a
Structured Streaming file source; each run picks up new files only (the checkpoint
remembers the rest), flattens them (S-2) and drops repeats of the same flight within the
watermark. State is bounded by the watermark: a key is forgotten once event time has
moved past it by ``delay``. Rows without a complete key (no scheduled departure, number or
end) cannot be told to be repeats by it; they go to a side folder untouched, and readers
drop only those that agree in every field (``distinct_incomplete``).

Two stages, each an exactly-once file-to-file stream with its own checkpoint:
bronze parses the landed JSON once into Parquet (all rows, the raw history); silver reads
bronze as a columnar stream and writes the de-duplicated rows and the incomplete ones. A
de-duplication with other keys can be re-run from bronze without parsing JSON again.

Rows that arrive behind the watermark (a re-poll of last week, say, or files out of time
order over several micro-batches) are not de-duplicated by the stream: Structured Streaming
drops them from the silver output. They are still in bronze, which keeps every row. A third
stream reads the same new bronze files after silver has, and writes those of their flights that no
output holds to a late table (first-seen row per key), so sink, late and untimed tables together
hold every flight. The key holds the scheduled departure, so both tables are partitioned by it
(``GRAIN``) and a run looks up its keys only in the days that it brought: its cost follows the new
files, not history.
``reconcile_dedup`` rebuilds the exact de-duplicated table from bronze in batch (first-seen
row per key, and the incomplete rows).
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightops.operators.joins import sized_broadcast
from flightops.sources.landing import LANDED_ENVELOPE, derived_columns, flights_from_envelopes
from flightops.sources.sinks import _hadoop_path

# The columns that identify one flight leg for de-duplication.
DEDUP_KEYS = ["flight_id", "scheduled_dep", "origin_icao", "dest_icao"]


@dataclass
class DedupPaths:
    sink: str           # de-duplicated flights (Parquet)
    untimed: str        # rows without a complete key (Parquet)
    checkpoint: str     # one sub-folder per streaming query, and the bronze table
    slices: int = 1     # of the keys, by hash, each de-duplicated by a stream of its own, one after the other

    @property
    def sinks(self) -> list[str]:
        """The sink's folders: one a slice, as each stream keeps its own log of files."""
        return [self.sink] if self.slices == 1 else [f"{self.sink}/slice-{k}" for k in range(self.slices)]

    @property
    def bronze(self) -> str:
        return f"{self.checkpoint}/bronze-table"

    @property
    def late(self) -> str:
        """Flights behind the watermark, de-duplicated (Parquet)."""
        return f"{self.checkpoint}/late-table"


def complete_key() -> Column:
    on = F.lit(True)
    for c in DEDUP_KEYS:
        on = on & F.col(c).isNotNull()
    return on


def distinct_incomplete(flights: DataFrame) -> DataFrame:
    """The rows without a complete key, one of those that agree in every field: two aircraft
    that leave at one minute without a number stay two flights."""
    fields = [c for c in flights.columns if c != "seen_order"]
    return (flights.where(~complete_key()).groupBy(*fields)
            .agg(F.min("seen_order").alias("seen_order")).select(*flights.columns))


def dedupe_flights(flights: DataFrame, delay: str = "3 days", salt_buckets: int = 1) -> DataFrame:
    """Streaming (or batch) de-duplication on DEDUP_KEYS within the watermark ``delay``.
    The poll goes back three days, so a repeat can arrive up to three days later.

    ``salt_buckets`` > 1 splits hot keys: a first de-duplication on (keys, salt), the salt
    taken from the copy's landing identity, spreads the copies of one key over that many
    state tasks and leaves at most ``salt_buckets`` survivors per key; a second one on the
    keys alone keeps one. A key repeated on a third of all rows then costs no single task
    more than 1/``salt_buckets`` of its copies, for up to ``salt_buckets`` times the state.
    """
    timed = (flights.where(complete_key())
             .withColumn("event_time", F.col("scheduled_dep").cast("timestamp"))
             .withWatermark("event_time", delay))
    if salt_buckets > 1:
        salt = F.pmod(F.xxhash64(F.col("seen_order")), F.lit(salt_buckets))
        timed = (timed.withColumn("_salt", salt)
                 .dropDuplicatesWithinWatermark(DEDUP_KEYS + ["_salt"])
                 .drop("_salt"))
    return timed.dropDuplicatesWithinWatermark(DEDUP_KEYS).drop("event_time")


def dedupe_first_seen(flights: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact batch de-duplication: per complete DEDUP_KEYS the row seen first
    (``seen_order``), and the rows without a complete key (``distinct_incomplete``).

    ``min_by`` aggregates map-side first, so a key repeated on a third of all rows still
    leaves one candidate per map task. ``columns`` names those wanted (None: all): of rows with a
    complete key no other is exchanged, which the planner can't see inside the aggregate."""
    columns = columns or flights.columns
    cols = [c for c in columns if c not in DEDUP_KEYS]
    found = flights.where(complete_key()).groupBy(*DEDUP_KEYS)
    if cols:
        found = found.agg(F.min_by(F.struct(*cols), F.col("seen_order")).alias("_first")).select(*DEDUP_KEYS, "_first.*")
    else:
        found = found.agg(F.count(F.lit(1)).alias("_n"))
    return found.select(*columns).unionByName(distinct_incomplete(flights).select(*columns))


#: Files of one micro-batch: a backlog is worked off in batches of bounded state and memory.
MAX_FILES_PER_TRIGGER = 10_000
#: Partition column of bronze: whether the de-duplication key is complete.
COMPLETE = "complete"
#: Partition column of bronze where there are several slices: the slice that a complete key belongs to.
SLICE = "slice"
#: Partition column of the sink and the late table: the scheduled departure, cut to GRAIN.
DEPARTS = "departs"
GRAIN = "yyyy-MM-dd"


def reconcile_dedup(spark: SparkSession, paths: DedupPaths, columns: list[str] | None = None) -> DataFrame:
    """The exact de-duplicated flights from bronze, late rows included."""
    return dedupe_first_seen(spark.read.parquet(paths.bronze).drop(COMPLETE, SLICE), columns)


def streamed_dedup(spark: SparkSession, paths: DedupPaths) -> DataFrame:
    """Every flight of the outputs once: the sink, the late table, and the incomplete rows."""
    return (_kept_flights(spark, paths).drop(DEPARTS)
            .unionByName(distinct_incomplete(_kept(spark, paths.untimed).drop(DEPARTS))))


def _kept_flights(spark: SparkSession, paths: DedupPaths) -> DataFrame:
    """The sink and the late table as they are now."""
    return reduce(DataFrame.unionByName, [_kept(spark, p) for p in (*paths.sinks, paths.late)])


def _kept(spark: SparkSession, path: str) -> DataFrame:
    """An output as it is now; without rows before anything was written."""
    schema = _bronze_schema(spark)
    schema = T.StructType([f for f in schema.fields if f.name != COMPLETE] + [T.StructField(DEPARTS, T.StringType())])
    where = _hadoop_path(spark, path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _to_bronze(flights: DataFrame, slices: int = 1) -> DataFrame:
    """Flights with bronze's partition columns."""
    flights = flights.withColumn(COMPLETE, complete_key())
    if slices == 1:
        return flights
    return flights.withColumn(SLICE, F.when(F.col(COMPLETE), F.pmod(F.xxhash64(*DEDUP_KEYS), F.lit(slices))).otherwise(0).cast("int"))


def _bronze_schema(spark: SparkSession, slices: int = 1):
    return _to_bronze(flights_from_envelopes(spark.createDataFrame([], LANDED_ENVELOPE)), slices).schema


def run_dedup_ingest(spark: SparkSession, landing_path: str, paths: DedupPaths,
                     delay: str = "3 days", max_files_per_trigger: int = MAX_FILES_PER_TRIGGER,
                     salt_buckets: int = 1, grain: str = GRAIN) -> None:
    """Process every landed file not yet seen, then stop (availableNow). Bronze is written
    split by whether the key is complete, so both readers after it read only their folder.
    Flights that the streams dropped as late are then added to the late table. ``grain`` (a date
    pattern, the same in every run) cuts departures to the partitions of sink and late table:
    days, or longer where a day holds only a handful of rows.

    A batch holds what it exchanges, whole rows twice, until it ends. With ``paths.slices`` (the same in every
    run) the keys are dealt to that many streams, which run one after the other: a backlog then takes that part of
    the disk. Columns that follow from others aren't exchanged."""
    reader = (spark.readStream.schema(LANDED_ENVELOPE).option("mode", "PERMISSIVE")
              .option("maxFilesPerTrigger", max_files_per_trigger))
    by = [COMPLETE] if paths.slices == 1 else [COMPLETE, SLICE]
    bronze = (_to_bronze(flights_from_envelopes(reader.json(landing_path)), paths.slices)
              .writeStream.format("parquet").option("compression", "zstd").partitionBy(*by)
              .option("path", paths.bronze)
              .option("checkpointLocation", f"{paths.checkpoint}/bronze")
              .trigger(availableNow=True).start())
    bronze.awaitTermination()

    flights = (spark.readStream.schema(_bronze_schema(spark, paths.slices))
               .option("maxFilesPerTrigger", max_files_per_trigger).parquet(paths.bronze))
    timed = flights.where(F.col(COMPLETE)).drop(COMPLETE, SLICE)
    departs = F.date_format("scheduled_dep", grain)
    untimed = (flights.where(~F.col(COMPLETE)).drop(COMPLETE, SLICE).writeStream.format("parquet")
               .option("compression", "zstd").option("path", paths.untimed)
               .option("checkpointLocation", f"{paths.checkpoint}/untimed")
               .trigger(availableNow=True).start())
    for k, sink in enumerate(paths.sinks):
        own = timed if paths.slices == 1 else flights.where(F.col(COMPLETE) & (F.col(SLICE) == k)).drop(COMPLETE, SLICE)
        kept = dedupe_flights(own.drop(*derived_columns()), delay, salt_buckets)
        deduped = (kept.withColumns(derived_columns()).select(*own.columns).withColumn(DEPARTS, departs)
                   .writeStream.format("parquet").option("compression", "zstd").partitionBy(DEPARTS)
                   .option("path", sink)
                   .option("checkpointLocation", f"{paths.checkpoint}/dedup" + (f"-{k}" if paths.slices > 1 else ""))
                   .trigger(availableNow=True).start())
        deduped.awaitTermination()
        del deduped   # it holds the last batch
        if paths.slices > 1:
            # a stream's exchanges go when the driver collects its garbage, which may be after all slices; its
            # thread ends a little after the query
            time.sleep(1)
            spark.sparkContext._jvm.System.gc()
    untimed.awaitTermination()
    late = (timed.withColumn(DEPARTS, departs).writeStream
            .foreachBatch(lambda batch, _: late_flights(batch, paths).write.mode("append")
                          .partitionBy(DEPARTS).parquet(paths.late))
            .option("checkpointLocation", f"{paths.checkpoint}/late")
            .trigger(availableNow=True).start())
    late.awaitTermination()


def late_flights(new: DataFrame, paths: DedupPaths) -> DataFrame:
    """The flights of new bronze rows (with their partition) that neither the sink nor the late
    table holds. Only the partitions that the rows depart in are read, chosen by literals; a batch
    that runs again after a failure finds its own rows in the late table and adds none.

    The keys alone are compared, each once. Where those found late are few (checked), the whole rows
    are looked up by them without an exchange."""
    spark = new.sparkSession
    key = [DEPARTS, *DEDUP_KEYS]
    days = sorted(r[0] for r in new.select(DEPARTS).distinct().collect())
    known = _kept_flights(spark, paths).where(F.col(DEPARTS).isin(days)).select(*key)
    keys = new.select(*key).distinct().join(known, key, "left_anti")
    late = new.join(sized_broadcast(keys), key, "left_semi").select(*new.columns)
    return dedupe_first_seen(late)
