"""Join helpers: broadcast only behind a proven size bound, in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest dimension, in bytes of its values, that is shipped to every executor.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
#: Rows read at most by the size check; a table with more is not broadcast.
BROADCAST_MAX_ROWS = 1_000_000


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 8 a column, and the length of every text or binary value."""
    total = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return total


def has_bounded_size(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES,
                     max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Whether ``df`` has at most ``max_bytes`` (and ``max_rows``). Reads at most
    ``max_rows`` + 1 rows whatever the table size. Nested columns have no such bound."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    if any(isinstance(f.dataType, nested) for f in df.schema.fields):
        return False
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"),
                                       F.sum(row_bytes(df).cast("long")).alias("b")).first()
    return found["n"] <= max_rows and (found["b"] or 0) <= max_bytes


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES,
                    max_rows: int = BROADCAST_MAX_ROWS, bounded: bool | None = None) -> DataFrame:
    """``broadcast(df)`` when it provably stays within the bounds, else ``df`` as is.
    ``bounded`` is the answer of an earlier check of the same table.

    Beyond the bound the join stays a shuffle join; AQE may still switch it to a
    broadcast at runtime from measured shuffle sizes, which is also a checked size.
    """
    if bounded is None:
        bounded = has_bounded_size(df, max_bytes, max_rows)
    return F.broadcast(df) if bounded else df
