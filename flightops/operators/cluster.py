"""Clustered fact (X-4, X-5): rows of like airline, origin and status stand together.

The explorer filters by equality on any of three columns, so no sort by one of them serves the
others. Rows are sorted by a Z-order key instead, the interleaved bits of the three values' hashes:
whichever column a filter names, its rows lie in few runs, and a row group whose dictionary (or
range) lacks the value is skipped. Hashes need no table of values and take any domain; a value on
a third of all rows is still cut by the bits of the other two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that the explorer filters on, the most telling bits first.
CLUSTER_COLUMNS = ("airline_name", "origin_icao", "status")
BITS = 8
Z_KEY = "_z"


def z_key(columns: tuple[str, ...] = CLUSTER_COLUMNS, bits: int = BITS) -> Column:
    """Interleaved leading hash bits of the columns (NULL hashes too)."""
    parts = []
    for b in range(bits):
        for k, c in enumerate(columns):
            bit = F.shiftrightunsigned(F.xxhash64(c), 63 - b).bitwiseAND(F.lit(1).cast("long"))
            parts.append(F.shiftleft(bit, (bits - 1 - b) * len(columns) + len(columns) - 1 - k))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def clustered(df: DataFrame, partition_by: str, columns: tuple[str, ...] = CLUSTER_COLUMNS,
              cell_bits: int = 2) -> DataFrame:
    """Rows dealt by partition and the first Z bits, and sorted by Z inside a partition: ready for
    ``partitionBy(partition_by)``, which keeps that order. AQE puts small cells together and
    splits large ones; nothing is sampled."""
    shift = len(columns) * (BITS - cell_bits)
    keyed = df.withColumn(Z_KEY, z_key(columns)).withColumn("_cell", F.shiftright(Z_KEY, shift))
    return (keyed.hint("rebalance", partition_by, "_cell").sortWithinPartitions(partition_by, Z_KEY)
            .drop(Z_KEY, "_cell"))


def write_clustered(df: DataFrame, path: str, partition_by: str, row_group_bytes: int = 16 << 20) -> None:
    """Publish a clustered copy of a fact. Row groups are the unit that a filter skips, so they
    are kept smaller than the default."""
    (clustered(df, partition_by).write.mode("overwrite").option("parquet.block.size", row_group_bytes)
     .partitionBy(partition_by).parquet(path))
