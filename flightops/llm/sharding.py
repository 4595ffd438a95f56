"""Histogram sort: documents into shards of nearly equal bytes.

Rows are ordered by a 62-bit key. Splitters between shards are found by counting: each
round counts rows and bytes exactly below evenly spaced probe boundaries (one grouped
aggregation), then only the key ranges that still matter are probed again, finer, until
every splitter is within tolerance of its target. The counts give each range its shard and
its first slot, so one exchange by range, and a sort within each range, places all rows.

The leading 32 bits of the key are the CRC-32 of the text, so equal texts stand together
(in the same shard unless a splitter falls among them); then come hash bits of the id, and
last of a row number made once with the checkpointed input, so that a text that a third of all
rows share, or a row repeated on them, is split like any other range. Ranges hold `range_rows`
rows at most (of very large tables a 16,384th of all rows), however hot a text, and a range
is what one task sorts at a time; so some 10^4 ranges, whatever the table, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, table, text_or_empty

KEY_BITS = 62
FIRST_BITS = 12   # 4,096 probes in the first round
RANGE_BITS = 14   # a range may always hold this part (1 / 2^14) of all rows
ID_BITS, ROW_BITS = 14, 16  # of the key, below the text's CRC-32
MORE_BITS = 8     # 256 in each range probed again


def text_crc(text: str = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as no bytes."""
    return F.crc32(text_or_empty(text).cast("binary"))


def _cut_levels() -> list[int]:
    """The lowest key bit of each round's probes."""
    shifts = [KEY_BITS - FIRST_BITS]
    while shifts[-1] > 0:
        shifts.append(max(0, shifts[-1] - MORE_BITS))
    return shifts


def probe_ranges(keyed: DataFrame, shards: int, tolerance: float, range_rows: int):
    """(ranges, cuts, levels): disjoint ranges in key order as (level, prefix, rows, bytes);
    the prefixes probed again in each round. `keyed` has the columns _key and _size.

    What reaches the driver: 4,096 counts, and 256 for each range probed again, which are
    the at most `shards` - 1 ranges around splitters and the ranges over `range_rows` rows,
    so rows / range_rows in order of size.
    """
    shifts = _cut_levels()

    def count(df, shift):
        rows = (df.groupBy(F.shiftright("_key", shift).alias("p"))
                .agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect())
        return {r.p: (r.n, r.b) for r in rows}

    found = {(0, p): v for p, v in count(keyed, shifts[0]).items()}
    total_rows = sum(n for n, _ in found.values())
    total = sum(b for _, b in found.values())
    # a range is small beside a task's share, at any size of the input
    limit = min(max(range_rows, total_rows >> RANGE_BITS), max(1, total_rows >> FIRST_BITS) * 4)
    cuts: list[list[int]] = []
    for level, shift in enumerate(shifts):
        order = sorted(found, key=lambda lp: lp[1] << shifts[lp[0]])
        targets = [total * k / shards for k in range(1, shards)]
        again, below, at = set(), 0, 0
        for lp in order:
            n, b = found[lp]
            while at < len(targets) and targets[at] <= below + b:
                # the nearer end of this range, if near enough, is the splitter
                gap = min(targets[at] - below, below + b - targets[at])
                if gap > tolerance * total / shards:
                    again.add(lp)
                at += 1
            if n > limit:
                again.add(lp)
            below += b
        again = {lp for lp in again if lp[0] == level and found[lp][0] > 1}
        if not again or level + 1 == len(shifts):
            return order, found, cuts, shifts
        prefixes = sorted(p for _, p in again)
        cuts.append(prefixes)
        finer = count(keyed.join(_literal(keyed.sparkSession, prefixes), 
                                 F.shiftright("_key", shift) == F.col("_cut"), "left_semi"),
                      shifts[level + 1])
        for lp in again:
            del found[lp]
        found |= {(level + 1, p): v for p, v in finer.items()}
    raise AssertionError("unreachable")


def _literal(spark: SparkSession, prefixes: list[int]) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in prefixes],
                                 T.StructType([T.StructField("_cut", T.LongType())]))
    return F.broadcast(rows)  # see probe_ranges: as many as ranges probed again


def assign_shards(df: DataFrame, key: Column, size: Column, shards: int, order: list[Column],
                  tolerance: float = 0.002, range_rows: int = 50_000) -> DataFrame:
    """df with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard, in key
    order): the bytes of shards are equal but for the tolerance and the size of one row.

    key: a long of 62 bits, evaluated once; rows with equal keys can't be parted by a
    splitter and stay in one range, so let its last bits tell repeated rows apart. order: breaks ties among them. Columns of df named shard
    or slot are replaced; an empty table stays empty. Null keys count as 0, null sizes as 0.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    keyed = checkpointed(df.select(
        *kept, F.coalesce(key, F.lit(0)).cast("long").alias("_key"),
        F.coalesce(size, F.lit(0)).cast("long").alias("_size")))
    ranges, counts, cuts, shifts = probe_ranges(keyed, shards, tolerance, range_rows)
    total = sum(b for _, b in counts.values())

    placed, below, shard, slot, first = [], 0, 0, 0, True
    for lp in ranges:
        n, b = counts[lp]
        # the shard whose span holds the middle of this range
        while shard < shards - 1 and below + b / 2 > total * (shard + 1) / shards:
            shard, slot = shard + 1, 0
        placed.append((lp[0], lp[1], shard, slot))
        slot += n
        below += b
    spark = df.sparkSession
    places = spark.createDataFrame(placed, "_level int, _prefix long, shard int, _first long")

    def prefix(level: int) -> Column:
        return F.shiftright("_key", shifts[level])

    ranged = keyed.withColumn("_level", F.lit(0)).withColumn("_prefix", prefix(0))
    for level, prefixes in enumerate(cuts):
        again = _literal(spark, prefixes).withColumn("_again", F.lit(True))
        ranged = (ranged.join(again, (F.col("_level") == level) & (F.col("_prefix") == F.col("_cut")),
                              "left")
                  .withColumn("_prefix", F.when(F.col("_again"), prefix(level + 1))
                              .otherwise(F.col("_prefix")))
                  .withColumn("_level", F.when(F.col("_again"), level + 1)
                              .otherwise(F.col("_level")))
                  .drop("_again", "_cut"))
    within = Window.partitionBy("_level", "_prefix").orderBy("_key", *order)
    return (ranged.join(F.broadcast(places), ["_level", "_prefix"])  # one row a range
            .withColumn("slot", F.row_number().over(within) - 1 + F.col("_first"))
            .drop("_level", "_prefix", "_first", "_key", "_size"))


def shard_key(doc_id: str = "doc_id", crc: str = "text_crc32") -> Column:
    """The text's CRC-32, hash bits of the id, hash bits of the row's number."""
    of_id = F.xxhash64(doc_id).bitwiseAND((1 << ID_BITS) - 1)
    of_row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << ROW_BITS) - 1)
    return F.shiftleft(F.col(crc), ID_BITS + ROW_BITS).bitwiseOR(F.shiftleft(of_id, ROW_BITS)).bitwiseOR(of_row)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        text_crc().alias("text_crc32"))
    sharded = assign_shards(docs, shard_key(), F.col("size"), 24, [F.col("doc_id"), F.col("size")])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                          F.col("shard").cast("int").alias("shard"),
                          F.col("slot").cast("long").alias("slot"),
                          F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
