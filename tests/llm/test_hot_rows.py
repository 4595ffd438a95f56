"""Shards, mixes and samples where a third of all rows share an id, have none, or are equal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightops.llm import labelled, sharding, source_mixing


def test_equal_rows_are_spread_over_shards(spark):
    n = 30_000
    docs = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), F.col("id").cast("string"))).otherwise("one text").alias("text"))
    sized = docs.select("doc_id", F.lit(100).cast("long").alias("size"), sharding.text_crc().alias("text_crc32"))
    got = sharding.assign_shards(sized, sharding.shard_key(), F.col("size"), 24, [F.col("doc_id")]).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == n and len(counts) == 24 and abs(counts - n / 24).max() <= 0.01 * n / 24
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def _mix_by_definition(rows, budget=1.5, weights=(3, 1, 2), cap=2.0):
    """Targets of each source by filling, step by step."""
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, full = budget * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in order}
        full |= set(over)
        left = budget * sum(sizes.values()) - sum(cap * sizes[s] for s in full)


@pytest.mark.parametrize("ids", ["null", "one", "unique", "mixed"])
def test_every_source_ends_within_a_document_of_its_target(spark, ids):
    rng = np.random.default_rng(1)
    n = 9_000
    rows = [({"null": None, "one": 7, "unique": k, "mixed": [None, 7, k][k % 3]}[ids] if k % 3 != 2 or ids != "null" else k,
             [None, "a", "b", "c", "a", "a"][k % 6], int(rng.integers(0, 90))) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = source_mixing.mix_sources(df, F.col("size"), F.lit(1.0))
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "times"]
    want = _mix_by_definition(rows)
    got = out.groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("taken"), F.first("target").alias("target"),
                                    F.max("times").alias("most")).collect()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * r.target and abs(r.taken - r.target) <= 90 and r.most <= 2
    assert source_mixing.mix_sources(df.limit(0), F.col("size"), F.lit(1.0)).count() == 0


def test_the_samples_bound_holds_for_rows(spark):
    docs = spark.range(5_000).select(F.when(F.col("id") < 4_000, 3).otherwise(F.col("id")).alias("doc_id"),
                                     F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), *[(k, 1) for k in range(4_000, 5_000)]], "doc_id long, quality int")
    got = labelled.labelled_sample(docs, labels, 10).collect()
    assert len(got) <= 10 and len({r.doc_id for r in got}) == len(got)
    whole = labelled.labelled_sample(docs, labels, 10_000).where("doc_id = 3").collect()
    assert [tuple(r) for r in whole] in ([], [(3, "t0", 0)])
    assert labelled.labelled_sample(docs.limit(0), labels, 10).count() == 0
