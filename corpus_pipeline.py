"""The corpus pipeline: classify, apply rules, remove near copies, mix sources, pack.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of `documents`. run() applies them in order,
each over the whole output of the one before it, which is written as Parquet and read again
in between, so no stage recomputes another and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.llm.common import checkpointed, saved, small_batches, table
from flightops.llm.decision_lists import fit_rules, judge
from flightops.llm.neighbour_quality import fit, with_score
from flightops.llm.nnls_packing import pack_documents
from flightops.llm.simhash_dedup import simhash_components
from flightops.llm.source_mixing import mix_sources, prose_weight, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns if c in COLUMNS]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the nearest labelled neighbours vote for (score 0.5 or more)."""
    small_batches(spark)
    docs = docs.select(*_columns(docs))
    space = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, space, out="_score").where(F.col("_score") >= 0.5).drop("_score")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base and that no learned rule rejects. The rules are
    learned from all labelled documents: the stage before leaves hardly a bad one of them."""
    docs = docs.select(*_columns(docs))
    rules = fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    judged = judge(docs.withColumn("_whole", F.col("text")), rules)
    return judged.where("kept").withColumnRenamed("_whole", "text").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of SimHash near copies: the one with the least id (null
    ids last), among its rows the least text (null first), then the first row. Rows that
    share an id or have none are documents of their own."""
    small_batches(spark)
    docs = docs.select(*_columns(docs))
    held = saved(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = simhash_components(held, doc_id="_row", words=3, distance=3)
    named = checkpointed(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
                         .join(held.select("_row", "doc_id"), "_row"))
    # map-side combined, without texts; these are needed only where rows share the least id
    ids = named.groupBy("_group", "doc_id").agg(F.min("_row").alias("_row"), F.count("*").alias("_n"))
    least = checkpointed(
        ids.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_unnamed"), "doc_id",
                                                 "_row", "_n")).alias("_least"))
        .select("_group", "_least.*"))
    shared = least.where(F.col("_n") > 1).select("_group", F.col("doc_id").alias("_id"))
    tied = named.join(shared, "_group").where(F.col("doc_id").eqNullSafe(F.col("_id")))
    first = (tied.select("_row", "_group").join(held.select("_row", "text"), "_row")
             .groupBy("_group").agg(F.min(F.struct("text", "_row")).alias("_first")))
    kept = least.where(F.col("_n") == 1).select("_row").unionByName(first.select("_first._row"))
    return held.join(kept, "_row", "left_semi").select(docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources reach their shares; a document taken
    twice is two rows. Rows are numbered as they are read: `docs` is a written table."""
    docs = docs.select(*_columns(docs)).withColumn("_number", F.monotonically_increasing_id())
    words = word_count()
    mixed = mix_sources(docs, words, prose_weight(F.col("text"), words), row="_number")
    times = F.col("times").cast("int")
    return (mixed.where(times > 0).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times)))
            .select(*[F.col(f"`{c}`") for c in docs.columns if c != "_number"]))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into pieces and packs them into windows of 2,048 tokens."""
    small_batches(spark)
    packed = pack_documents(docs.select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("SimHash near-dedup", remove_near_copies),
    ("mixing sources", mix_to_weights),
    ("packing", pack_windows),
]

#: Model fitting, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
