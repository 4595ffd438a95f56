"""S-4 over many tasks: a saved JSON list, however large its file, read in byte ranges.

``json.load`` of one list, and Spark's multiLine reader as well, take a whole file in one task.
Here the text reader cuts the file at every ``}``; as it splits files by bytes, each range is
cut by its own task. Whether such a brace closes a document depends on everything before it: on
whether that leaves a string open, and on the depth of brackets. Each range is therefore reduced to a state
map (for either state at its start: quotes, change of depth, documents closed), the maps are composed
along the file by a running sum over its ranges, and then a running sum inside each range tells where
documents end. A document inside one range is put together there; one that crosses a border is put
together from its pieces, at most two a range and group.

Only built-in expressions; nothing but the ranges' maps is ordered per file. The list's elements must
be objects (as the reference saves them); anything else between them is skipped. Compressed files can't
be split: they are one range. A document that is cut off at the file's end is counted as corrupt.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightops import schemas
from flightops.session import new_scratch_path
from flightops.sources.landing import CORRUPT

RANGE = ["_file", "_range"]   # the file by a hash of its path: a path is longer than most pieces
#: Documents that a task holds at once. A range holds ``session.SPLIT_BYTES``; beyond that many the task sorts them
#: on disk.
DOCUMENTS_HELD = 1 << 20


def _count(text: Column | str, sign: str) -> Column:
    """How often a text holds a sign of one byte."""
    return F.octet_length(text) - F.octet_length(F.replace(F.col(text) if isinstance(text, str) else text, F.lit(sign), F.lit("")))


def _change(text: Column) -> Column:
    """Change of depth by the brackets of a piece (which holds no closing brace) that begins outside strings."""
    outside = F.regexp_replace(text, '"[^"]*+"?', "")
    return (_count(outside, "{") + _count(outside, "[") - _count(outside, "]")).cast("long")


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Texts between closing braces, in order inside a range, with what each does to the state.
    ``_if0`` / ``_if1``: the change of depth if it starts outside / inside a string."""
    cut = (spark.read.option("lineSep", "}").text(paths)
           .select(F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"),
                   F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_text")))
    # without escaped characters; few texts hold any
    cut = cut.withColumn("_plain", F.when(F.contains("_text", F.lit("\\")), F.regexp_replace("_text", r"\\.", ""))
                         .otherwise(F.col("_text")))
    quotes = _count("_plain", '"')
    # the brace that ended the piece closes one level where the piece ends outside a string
    return cut.select(*RANGE, "_at", "_text", quotes.cast("long").alias("_quotes"),
                      (_change(F.col("_plain")) - F.when(quotes % 2 == 0, 1).otherwise(0)).alias("_if0"),
                      (_change(F.concat(F.lit('"'), "_plain")) - F.when(quotes % 2 == 1, 1).otherwise(0)).alias("_if1"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Hash, path and bytes of each file; no file is read."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    files = files.select(F.xxhash64("file").alias("_file"), "file", "bytes")
    if not files.groupBy("_file").count().where("count > 1").isEmpty():
        raise ValueError(f"two files below {path} share a hash of their path: read them apart")
    return files


def _before(column: str | Column, window) -> Column:
    """Sum over the rows before this one."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


#: Lists are cut in turns of whole files, each of these bytes of text or a part of all: the exchange of one turn is
#: held at a time.
TURN_BYTES, MAX_TURNS = 512 << 20, 8


def _turns(files: DataFrame) -> list[list[str]]:
    """Paths of the files of each turn."""
    # names come as URIs; a reader takes them plain, its pattern signs escaped
    sized = [(re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(r["file"])), r["bytes"]) for r in files.orderBy("file").collect()]
    most = max(TURN_BYTES, sum(n for _, n in sized) // MAX_TURNS)
    turns, held = [[]], 0
    for file, n in sized:
        if turns[-1] and held + n > most:
            turns.append([])
            held = 0
        turns[-1].append(file)
        held += n
    return [t for t in turns if t]


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, text) of every document of the lists at ``path``; pos ascends along a list."""
    files = _files(spark, path)
    docs_path = new_scratch_path(spark, "list-documents")
    held = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(held)
    spark.conf.set(held, str(DOCUMENTS_HELD))
    try:
        # the branches below read them: written once, the cutting and its windows run once
        for turn in _turns(files) or [[path]]:
            docs = _cut_documents(spark, turn)
            docs.write.mode("append").option("compression", "zstd").parquet(docs_path)
    finally:
        spark.conf.set(held, before)
    docs = spark.read.schema(docs.schema).parquet(docs_path)
    # the first piece of a range may carry on the last of the range before
    crossing = docs.where((F.col("_doc") == 0) | (F.col("_ends") == 0))
    within = docs.where((F.col("_doc") > 0) & (F.col("_ends") == 1)).select(
        "_file", F.struct("_range", "_doc").alias("pos"), "_text")
    # running number of the document that an unfinished piece belongs to, over the few pieces of a file
    order = Window.partitionBy("_file").orderBy("_range", "_doc")
    crossing = crossing.withColumn("_no", _before("_ends", order))
    joined = F.array_sort(F.collect_list(F.struct("_range", "_doc", "_text")))
    across = crossing.groupBy("_file", "_no").agg(joined.alias("_j"), F.max("_ends").alias("_ends"))
    across = across.select("_file", F.struct(F.col("_j")[0]["_range"].alias("_range"), F.col("_j")[0]["_doc"].alias("_doc")).alias("pos"),
                           F.array_join(F.transform("_j", lambda x: x["_text"]), "}").alias("_text"), "_ends")
    across = across.where((F.col("_ends") == 1) | F.col("_text").contains("{")).drop("_ends")
    text = F.concat(F.regexp_replace("_text", r"^[^{]*", ""), F.lit("}"))
    return within.unionByName(across).join(F.broadcast(files), "_file").select("file", "pos", text.alias("text"))


def _cut_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The documents of each range of some files, and whether each ends there."""
    inside = Window.partitionBy(*RANGE).orderBy("_at")
    # either start of the range: the quotes before a piece inside it decide which change holds
    p = _pieces(spark, paths).withColumn("_odd", _before("_quotes", inside) % 2)
    for start in (0, 1):
        p = p.withColumn(f"_d{start}", F.when(F.col("_odd") == start, F.col("_if0")).otherwise(F.col("_if1")))
    maps = p.groupBy(*RANGE).agg(F.sum("_quotes").alias("_quotes"), F.sum("_d0").alias("_d0"), F.sum("_d1").alias("_d1"))
    along = Window.partitionBy("_file").orderBy("_range")
    maps = maps.withColumn("_open", _before("_quotes", along) % 2)
    maps = maps.withColumn("_depth", _before(F.when(F.col("_open") == 0, F.col("_d0")).otherwise(F.col("_d1")), along))
    p = p.join(maps.select(*RANGE, "_open", "_depth"), RANGE)
    p = p.withColumn("_change", F.when(F.col("_open") == 0, F.col("_d0")).otherwise(F.col("_d1")))
    after = F.col("_depth") + F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ended = (F.col("_open") + F.col("_odd") + F.col("_quotes")) % 2 == 0   # outside a string
    p = p.withColumn("_ends", (ended & (after == 1)).cast("long")).withColumn("_doc", _before("_ends", inside))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]), "}")
    # a document's pieces of one range meet without another exchange
    return p.groupBy(*RANGE, "_doc").agg(whole.alias("_text"), F.max("_ends").alias("_ends"))


def read_flight_list_split(spark: SparkSession, path: str) -> DataFrame:
    """The documents of saved flight lists as ``landing.read_flight_list`` gives them, and the place
    of each (``place``: file, range and number inside it; it ascends along a list)."""
    schema = T.StructType([*schemas.FLIGHT_DOC.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return list_documents(spark, path).select(F.struct("file", "pos").alias("place"), parsed.alias("f")).select("place", "f.*")
