"""Token counts by a compiled finite-state transducer (see transducer.py)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .common import small_batches, table
from .transducer import (BREAK, BREAK_CODE, LETTER, NUMBER, OTHER, SPECIAL_CODE, START, Transducer,
                         WordBpe)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Code points walked at once in a task: bounds its arrays to some tens of MB.
STREAM = 2_000_000


@functools.lru_cache(maxsize=2)
def _transducer(path: str) -> Transducer:
    return Transducer(WordBpe(path))


@functools.lru_cache(maxsize=1 << 16)
def _kind(path: str, char: str) -> int:
    """The class of a character, asked of the library's own cutter."""
    cut = pretokens.library(path).pre_tokenizer.pre_tokenize_str
    if not cut(char):
        return BREAK
    if len(cut("a" + char)) == 1:
        return LETTER
    return NUMBER if len(cut(char + char)) == 2 else OTHER


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text. Texts are streams of code points with a break after each part; the
    transducer takes them STREAM code points at a time and goes on from the state it reached, so
    neither one long text nor many characters make its arrays grow."""
    machine = _transducer(path)
    kind = functools.partial(_kind, path)
    totals = np.zeros(len(texts), dtype=np.int64)
    parts: list[np.ndarray] = []
    owners: list[int] = []
    size, state = 0, START

    def flush():
        nonlocal parts, owners, size, state
        if size:
            at = machine.fit(state)
            symbols, taken = machine.spelled(np.concatenate(parts), kind)
            found, at = machine.scan(symbols, at)
            state = machine.states[at]
            ends = np.cumsum(taken)
            begins = np.concatenate([[0], ends[np.cumsum([len(p) for p in parts[:-1]]).astype(np.int64) - 1]]) \
                if len(parts) > 1 else np.zeros(1, np.int64)
            np.add.at(totals, owners, np.add.reduceat(found.astype(np.int64), begins))
        parts, owners, size = [], [], 0

    break_, special = (np.array([c], dtype=np.uint32) for c in (BREAK_CODE, SPECIAL_CODE))
    for k, text in enumerate(texts):
        for mark, part in pretokens.segments(text, path):
            codes = special if mark else np.frombuffer(
                pretokens.normalised(part, path).encode("utf-32-le", "surrogatepass"), "<u4")
            for piece in (*(codes[x:x + STREAM] for x in range(0, len(codes), STREAM)), break_):
                parts.append(piece)
                owners.append(k)
                size += len(piece)
                if size >= STREAM:
                    flush()
    flush()
    return totals


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens",
                 tokenizer: str = TOKENIZER) -> DataFrame:
    """df with the number of tokens of each whole text in column `out` (replaced where it
    exists). Null and empty texts have 0 tokens; equal texts and repeated rows count alike;
    an empty table stays empty; all other columns pass through."""
    df = df.drop(out) if out in df.columns else df
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(count_texts(texts, tokenizer), pa.int64())],
                names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
