"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w: u is uniform and depends on its id
alone (on its row's number, where it has no id), w is its quality weight. Within a source, documents are taken in key order until the
prefix sum of their sizes reaches the source's budget; a budget above the source's size
first takes every document in complete epochs, then samples the rest.

The sorted prefix sum is taken in levels, so no source, however large, meets in one task:
sizes are pre-aggregated by key bucket, the bucket sums are prefix-summed, and only the one
bucket in which a source's budget ends is looked into. There rows of one key and id are one sum
each; of the one key and id in which the budget ends, rows are summed by slots, a hash of the row's
number; and only the rows of one slot are sorted. So an id that a third of all rows share is
split as well, and every source ends within one document of its target. That gives each
source one threshold, and taking documents is a map over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed, saved, table

BUCKETS = 4096
#: Sources up to which their table of thresholds is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 50_000
TYPICAL_WORD = 6.5  # characters of a word of prose with the white space after it


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prose_weight(text: Column, words: Column) -> Column:
    """A document's quality weight, 0.05 to 1: highest where a word takes as many characters
    as in prose (junk of symbols, run-on or one-letter words scores low)."""
    gap = (F.coalesce(F.length(text), F.lit(0)).cast("double") / F.greatest(words, F.lit(1))
           - TYPICAL_WORD)
    return F.greatest(F.lit(0.05), F.lit(1.0) / (F.lit(1.0) + gap * gap / 4.0))


def uniform(name: str, row: Column | None = None) -> Column:
    """Uniform in (0, 1), from the id alone: reruns agree. Without an id, from the row's number."""
    known = F.col(name).cast("string")
    if row is not None:
        known = F.coalesce(known, F.concat(F.lit("row "), row.cast("string")))
    digits = F.substring(F.md5(F.coalesce(known, F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, budget: float, weights: list[int], cap: float) -> DataFrame:
    """sizes: one row a source (_src, source_size). Weights repeat along the sources by code
    point, null last. target: the source's share of budget * all sizes; a target stops at
    cap * source_size, and the excess is shared again by weight until none is above (sources
    are filled in the order in which they reach their caps). One row a source passes through
    one task; documents don't."""
    by_name = Window.orderBy(F.col("_src").isNull(), "_src")
    ranked = sizes.withColumn("_w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    filling = (Window.orderBy(F.col("source_size") / F.col("_w"), F.col("_src").isNull(), "_src")
               .rowsBetween(Window.unboundedPreceding, -1))
    limits = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    limits = limits.withColumns({
        "_budget": F.sum("source_size").over(everything) * F.lit(float(budget)),
        "_all_w": F.sum("_w").over(everything),
        "_below": F.coalesce(F.sum("_cap").over(filling), F.lit(0.0)),
        "_below_w": F.coalesce(F.sum("_w").over(filling), F.lit(0.0))})
    limits = limits.withColumn(
        "_full", F.col("_cap") * (F.col("_all_w") - F.col("_below_w"))
        <= (F.col("_budget") - F.col("_below")) * F.col("_w"))
    full = F.col("_full")
    left = F.col("_budget") - F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).over(everything)
    open_w = F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).over(everything)
    return limits.select("_src", "source_size", F.when(full, F.col("_cap"))
                         .otherwise(F.col("_w") * left / open_w).alias("target"))


def _ends_in(parts: DataFrame, plan: DataFrame, group: list[str], order: list[str], found: list[str]) -> DataFrame:
    """parts: `group` columns (the source first), `order` columns, _sum. Along the order, the
    last part that begins within the source's _rest (less what stands before, _from): plan's
    columns, the part's `order` columns as named in `found`, and what is before it as _from."""
    along = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    p, s = plan.alias("p"), parts.alias("s")
    begins = F.col("s._before") + F.col("p._from")
    on = F.col("s._src").eqNullSafe(F.col("p._src")) & (begins <= F.col("p._rest")) & (F.col("p._rest") > 0)
    at = F.max(F.struct(begins.alias("_from"), *[F.col(f"s.{c}").alias(n) for c, n in zip(order, found, strict=True)]))
    kept = [c for c in plan.columns if c != "_from"]
    # of parts that begin at one sum (sizes of 0) the last in order
    return (s.join(p, on).groupBy(*[f"p.{c}" for c in kept]).agg(at.alias("_at"))
            .select(*kept, "_at._from", *[f"_at.{n}" for n in found]))


def mix_plan(lite: DataFrame, budget: float, weights: list[int], cap: float) -> DataFrame:
    """One row a source: source_size, target, _epochs, and where the fractional selection
    ends: key, id and slot (_k, _i, _s), and the last row of that slot that it takes (_r). lite:
    _src, _id, _size, _key, _row of every document."""
    sizes = lite.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    plan = source_targets(sizes, budget, weights, cap)
    size = F.col("source_size")
    plan = checkpointed(plan.withColumn(
        "_epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("_epochs") * size))
    bucketed = lite.withColumn("_bucket", F.floor(F.col("_key") / (F.lit(1.0) + F.col("_key")) * BUCKETS).cast("int")) \
        .withColumn("_slot", row_slot(F.col("_row")))
    ends = plan.select("_src", "_rest", F.lit(0).cast("long").alias("_from"))

    def inside(ends: DataFrame, *same: tuple[str, str]) -> DataFrame:
        on = F.col("s._src").eqNullSafe(F.col("p._src"))
        for column, found in same:
            on = on & F.col(f"s.{column}").eqNullSafe(F.col(f"p.{found}"))
        return bucketed.alias("s").join(ends.alias("p"), on).select("s.*")

    def sums(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy("_src", *by).agg(F.sum("_size").alias("_sum"))
    ends = checkpointed(_ends_in(sums(bucketed, "_bucket"), ends, ["_src"], ["_bucket"], ["_b"]))
    at_key = sums(inside(ends, ("_bucket", "_b")), "_key", "_id")
    ends = checkpointed(_ends_in(at_key, ends, ["_src"], ["_key", "_id"], ["_k", "_i"]))
    here = (("_bucket", "_b"), ("_key", "_k"), ("_id", "_i"))
    ends = checkpointed(_ends_in(sums(inside(ends, *here), "_slot"), ends, ["_src"], ["_slot"], ["_s"]))
    rows = inside(ends, *here, ("_slot", "_s"))
    along = Window.partitionBy("_src").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("_src", "_row", "_size", F.sum("_size").over(along).alias("_sum"))
    cut = (rows.alias("s").join(ends.alias("p"), F.col("s._src").eqNullSafe(F.col("p._src")))
           # a document on the edge is taken if that brings the sum nearer
           .where(F.col("s._sum") + F.col("p._from") - F.col("s._size") / 2 <= F.col("p._rest"))
           .groupBy("p._src").agg(F.max("s._row").alias("_r")))
    same = lambda other: F.col("p._src").eqNullSafe(F.col(f"{other}._src"))
    return (plan.alias("p").join(ends.alias("e"), same("e"), "left").join(cut.alias("c"), same("c"), "left")
            .select("p._src", "p.source_size", "p.target", "p._epochs", "e._k", "e._i", "e._s", "c._r"))


def row_slot(row: Column) -> Column:
    return F.xxhash64(row).bitwiseAND(BUCKETS - 1)


def mix_sources(df: DataFrame, size: Column, weight: Column, doc_id: str = "doc_id",
                source: str = "source", budget: float = 1.5, weights: tuple = (3, 1, 2),
                cap: float = 2.0, row: str | None = None) -> DataFrame:
    """df with `source_size`, `target`, `times` (how often the mix takes the row: complete
    epochs, and once more if sampled) added; rows with 0 times stay, marked.

    row: a column of df that numbers its rows, the same whenever df is read; without one
    df is written once with a number. Null sources form one source of their own, ordered last;
    null sizes count as 0 and such rows cost nothing; rows without an id are drawn by their
    number; rows with one id stand together in the order, and the budget may end among them; equal
    texts are separate documents. An empty table stays empty. Columns of df with the added
    names are replaced.
    """
    added = ("source_size", "target", "times")
    df = df.drop(*[c for c in added if c in df.columns])
    if row is None:
        row = "_row"
        marked = saved(df.withColumn(row, F.monotonically_increasing_id()).withColumns(
            {"_size": size, "_weight": weight}))
        size, weight = F.col("_size"), F.col("_weight")
    else:
        marked = df
    marked = marked.withColumns({
        "_size": F.coalesce(size, F.lit(0)).cast("long"),
        "_key": -F.log(uniform(doc_id, F.col(row))) / F.greatest(weight, F.lit(1e-6))})
    lite = checkpointed(marked.select(F.col(source).alias("_src"), F.col(doc_id).alias("_id"),
                                      "_size", "_key", F.col(row).alias("_row")))
    plan = checkpointed(mix_plan(lite, budget, list(weights), cap))
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = marked.join(plan, marked[source].eqNullSafe(plan["_src"]), "left")
    key, own, number, slot = F.col("_key"), F.col(doc_id), F.col(row), row_slot(F.col(row))
    # nulls sort first: a null id stands before every other
    id_before = F.coalesce(own < F.col("_i"), own.isNull() & F.col("_i").isNotNull())
    in_slot = (slot < F.col("_s")) | ((slot == F.col("_s")) & F.coalesce(number <= F.col("_r"), F.lit(False)))
    sampled = (key < F.col("_k")) | ((key == F.col("_k")) & (id_before | (own.eqNullSafe(F.col("_i")) & in_slot)))
    return (joined.withColumn("times", F.col("_epochs") + F.when(F.coalesce(sampled, F.lit(False)), 1).otherwise(0))
            .select(*df.columns, *added))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_count()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", words.alias("size"),
        prose_weight(F.col("text"), words).alias("weight"), F.monotonically_increasing_id().alias("_number"))
    docs = checkpointed(docs)  # sizes are counted once; the texts aren't read again
    mixed = mix_sources(docs, F.col("size"), F.col("weight"), row="_number")
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("times") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0
              ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         coalesce(length(text), 0)::DOUBLE AS chars,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5)
           / 281474976710656.0 AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / greatest(0.05, 1.0 / (1.0 + (chars / greatest(size, 1) - 6.5)
            * (chars / greatest(size, 1) - 6.5) / 4.0)) AS k
  FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM docs GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER fill, 0) AS below, coalesce(sum(w) OVER fill, 0) AS below_w
  FROM sources
  WINDOW fill AS (ORDER BY source_size / w, source IS NULL, encode(source)
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
  SELECT *, cap * (all_w - below_w) <= (budget - below) * w AS is_full FROM filled),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap
              ELSE w * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
                   / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target
  FROM capped),
summed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN target - epochs * source_size > 0
                        AND upto - size / 2.0 <= target - epochs * source_size
                       THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""

QUERIES = {"op3_source_mixing": op3_source_mixing}
ORACLES = {"op3_source_mixing": ORACLE}
