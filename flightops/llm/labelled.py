"""Bounded, documented samples of labelled documents for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket

#: Remainder of crc32(doc_id as text) mod 3 whose rows no model sees.
HELD_OUT, FOLDS = 1, 3


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` documents with a quality label (columns of docs, and _quality), outside
    the held-out fold, chosen by a hash of the id; several labels of one id count as their
    least. The sample of ids is small by its bound, so it is broadcast to the documents. Of the
    rows that share an id one stays (the least by its columns, map-side combined), so the bound
    holds for rows too; columns must be orderable."""
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                           & (id_bucket("doc_id", FOLDS) != HELD_OUT))
              .groupBy("doc_id").agg(F.min("quality").alias("_quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.join(F.broadcast(chosen), "doc_id")
    whole = F.struct(*[F.col(f"`{c}`") for c in found.columns if c != "doc_id"])
    return found.groupBy("doc_id").agg(F.min(whole).alias("_row")).select("doc_id", "_row.*").select(
        *[F.col(f"`{c}`") for c in found.columns])
