"""Quality by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled documents is turned into weighted term vectors (hashed byte
pairs, and terms for repetition) and decomposed on the driver; the leading singular vectors
span the space. The labelled vectors and the projection are broadcast. Every document is
projected, its cosines with all labelled vectors are computed exactly, in blocks, and its
nearest neighbours vote with their similarities as weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_bucket, small_batches, table
from .labelled import FOLDS, HELD_OUT, labelled_sample

SAMPLE_ROWS = 4096   # labelled vectors, at most: with DIMS, the size of the broadcast
DIMS = 64
GRAMS = 2048         # hashed byte pairs
MARKS = 2            # repeated lines, repeated word pairs
NEIGHBOURS = 15
SHARPNESS = 4.0      # votes weigh similarity to this power
BLOCK = 512          # documents whose cosines are computed at once

_PAIRS = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
          >> np.uint64(53)).astype(np.int64)  # pair of bytes -> one of 2,048 grams


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the grams of the whole text, then the shares of repeated lines and repeated
    word pairs. Null and empty texts have zeros."""
    out = np.zeros(GRAMS + MARKS, dtype=np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) > 1:
        b = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        out[:GRAMS] = np.bincount(_PAIRS[b[:-1] * 256 + b[1:]], minlength=GRAMS)
        lines = [x for x in data.split(b"\n") if x]
        words = data.split()
        if lines:
            out[GRAMS] = 1 - len(set(lines)) / len(lines)
        if len(words) > 1:
            out[GRAMS + 1] = 1 - len(set(zip(words, words[1:], strict=False))) / (len(words) - 1)
    return out


@dataclass(frozen=True)
class Space:
    weight: np.ndarray      # of each gram: its inverse document frequency
    basis: np.ndarray       # (terms, DIMS)
    vectors: np.ndarray     # labelled documents, unit length (rows, DIMS)
    labels: np.ndarray      # 0 or 1
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        unit = weighted(counts, self.weight) @ self.basis
        norm = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        return np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The similarity-weighted vote of the NEIGHBOURS nearest; of those that tie for the last
        places each counts for its share of these, so that no order among them decides. Without
        any similar neighbour, the sample's share."""
        out = np.full(len(counts), self.prior)
        if not len(self.vectors):
            return out
        near = min(NEIGHBOURS, len(self.vectors))
        # to five decimals: products in float32 agree no further
        cosines = np.round(self.project(counts) @ self.vectors.T, 5)
        last = np.partition(cosines, len(self.vectors) - near, axis=1)[:, len(self.vectors) - near]
        above, tied = cosines > last[:, None], cosines == last[:, None]
        share = np.where(above, 1.0, tied * ((near - above.sum(axis=1)) / tied.sum(axis=1))[:, None])
        row, at = np.nonzero(share)
        votes = share[row, at] * np.maximum(cosines[row, at], 0).astype(float) ** SHARPNESS
        total = np.bincount(row, votes, len(out))
        return np.divide(np.bincount(row, votes * self.labels[at], len(out)), total, out=out, where=total > 0)


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Damped counts times weights, of unit length over the grams; the repetition terms are
    shares already and stand beside them."""
    grams = np.log1p(counts[:, :GRAMS]) * weight
    norm = np.sqrt((grams * grams).sum(axis=1, keepdims=True))
    grams = np.divide(grams, norm, out=np.zeros_like(grams), where=norm > 0)
    return np.hstack([grams, counts[:, GRAMS:]])


def fit_space(counts: np.ndarray, labels: np.ndarray) -> Space:
    """The truncated singular value decomposition of the weighted sample, by subspace
    iteration from a fixed start."""
    weight = np.log((1 + len(counts)) / (1 + (counts[:, :GRAMS] > 0).sum(axis=0))).astype(np.float32)
    x = weighted(counts, weight)
    dims = min(DIMS, *x.shape) if len(x) else 1
    q = np.random.default_rng(0).standard_normal((x.shape[1], dims)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    space = Space(weight, q, np.zeros((0, dims), np.float32), labels.astype(float),
                  float(labels.mean()) if len(labels) else 0.5)
    return Space(weight, q, space.project(counts), space.labels, space.prior)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Space:
    """The space of the labelled documents among `docs` (doc_id, text), at most `rows`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([term_counts(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())],
                names=["doc_id", "_quality", "counts"])

    sample = labelled_sample(docs.select("doc_id", "text"), labels, rows)
    sample = sample.select(F.col("doc_id").cast("long"), F.col("_quality").cast("long"), "text") \
        .mapInArrow(count, "doc_id long, _quality long, counts binary").collect()
    sample.sort(key=lambda r: (r.doc_id, r.counts))
    counts = np.array([np.frombuffer(r.counts, np.float32) for r in sample],
                      dtype=np.float32).reshape(-1, GRAMS + MARKS)
    return fit_space(counts, np.array([r._quality > 0 for r in sample], dtype=bool))


def with_score(df: DataFrame, space: Space, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of each whole text (0 to 1, higher: label 1 likelier) in `out`
    (replaced where it exists). Null and empty texts have no neighbour and get the sample's
    share of label 1; equal texts score alike; an empty table stays empty; all other columns
    pass through and take no part."""
    df = df.drop(out) if out in df.columns else df
    place = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for k in range(0, batch.num_rows, BLOCK):
                texts = batch.column(place).slice(k, BLOCK).to_pylist()
                scores.append(shared.value.score(np.stack([term_counts(t) for t in texts])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.clip(np.concatenate(scores), 0, 1), pa.float64())],
                names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    space = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, space).select(
        "doc_id", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op4_neighbour_quality": op4_neighbour_quality}
ORACLES: dict[str, str] = {}
