"""Packing documents into fixed windows by non-negative least squares.

A document's whole windows stand alone; its rest (shorter than a window) is rounded up to a
length class. All shallow combinations of classes that fill a window exactly are enumerated,
and non-negative least squares finds how often to use each, so that together they use up the
histogram of rests. Repeat counts are rounded and limited to what the histogram holds; what
remains is packed greedily, longest first, cut where a window ends.

Only the histogram (one number a class) reaches the driver. Every rest finds its place from
its rank in its class, by a two-level running count, and a table of rank intervals with a
few rows a combination.
"""

from __future__ import annotations

import array
import codecs
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import pretokens
from .common import checkpointed, saved, small_batches, table
from .transducer import byte_letters

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WINDOW = 2048
STEP = 8          # tokens of a length class
DEPTH = 3         # rests in a combination, at most
END_ID = 1
MEMO = 500_000    # runs and words whose ids a worker remembers: as many again from before
CHUNK_ROWS = 2_000  # rows that a running count orders in one group, about


# -- token ids ---------------------------------------------------------------------------

class _Pieces(dict):
    """The ids of runs between blanks and of the words in them: a run is cut into words, and a word
    encoded, when it is first seen. The last MEMO ones are held, and the MEMO before them, from which
    one is taken over when it is asked for again: what stands in most texts stays known."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.letters, self.before = encode, "".join(byte_letters()), {}

    def spelt(self, letters: str) -> bytes:
        return array.array("I", [t.id for t in self.encode(letters)]).tobytes()

    def word(self, word: str) -> bytes:
        return self.spelt(word if word.isascii() and word.isprintable() else codecs.charmap_decode(
            word.encode("utf-8", "surrogatepass"), "strict", self.letters)[0])

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            # letters alone are one word
            words = (piece,) if piece.isalpha() else pretokens.CUT.findall(piece)
            found = self.word(words[0]) if len(words) == 1 else b"".join(map(self.__getitem__, words))
        self[piece] = found
        return found

    def trim(self) -> None:
        if len(self) > MEMO:
            self.before = dict(self)
            self.clear()


class _Ids:
    """Ids of runs between blanks and of words, as remembered. The cutter splits at white space
    and at words, so each has its ids wherever it stands, and the library encodes a distinct
    word once."""

    def __init__(self, path: str):
        self.library = pretokens.library(path)
        self.pieces = _Pieces(self.library.model.tokenize)

    def plain(self, text: str) -> bytes:
        """Of a text that lower-casing alone normalises."""
        return b"".join(map(self.pieces.__getitem__, text.lower().replace("\n", " ").split(" ")))

    def other(self, text: str) -> bytes:
        plain = self.library.normalizer.normalize_str(text)
        return b"".join(self.pieces.spelt(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain))

    def special(self, mark: str) -> bytes:
        return array.array("I", [self.library.token_to_id(mark)]).tobytes()

    def trim(self) -> None:
        self.pieces.trim()


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def token_ids(text: str, path: str) -> bytes:
    """The library's ids of a whole text, as unsigned 32 bits in the machine's byte order
    (little-endian on every platform that Spark supports with Arrow)."""
    ids = _ids(path)
    ids.trim()
    return b"".join(
        ids.special(mark) if mark else ids.plain(part) if pretokens.is_plain(part) else ids.other(part)
        for mark, part in pretokens.segments(text, path))

def with_ids(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """df without its text, with the binary column _ids: the text's ids and the end id."""
    kept = [c for c in df.columns if c not in (text, "_ids")]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [token_ids(t or "", tokenizer) + end for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())],
                                             names=[*kept, "_ids"])

    df = df.select(*[F.col(f"`{c}`") for c in kept], text)
    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1],
                                            T.StructField("_ids", T.BinaryType())]))


# -- the plan ----------------------------------------------------------------------------

def combinations(classes: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All descending tuples of at most `depth` classes (1 to classes) that sum to classes."""
    def fill(left: int, most: int, slots: int) -> list[tuple[int, ...]]:
        if not left:
            return [()]
        if not slots or most * slots < left:
            return []
        return [(c, *rest) for c in range(min(left, most), 0, -1)
                for rest in fill(left - c, c, slots - 1)]
    return fill(classes, classes, depth)


def solve_nnls(combos: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |A x - h|, where column j of A counts the classes of combination
    j (active-set method). histogram: rests by class, from class 1."""
    classes = len(histogram)
    columns = np.zeros((len(combos), classes + 1))
    for j, combo in enumerate(combos):
        for c in combo:
            columns[j, c - 1] += 1
    columns = columns[:, :classes]
    scale = max(1.0, float(histogram.max(initial=0)))
    h = histogram / scale
    x = np.zeros(len(combos))
    active = np.zeros(len(combos), dtype=bool)
    for _ in range(6 * classes):
        slope = columns @ (h - x @ columns)
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-9:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            a = columns[on]
            z = np.linalg.solve(a @ a.T + 1e-10 * np.eye(len(on)), a @ h)
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            down = z <= 0
            step = float((x[on][down] / np.maximum(x[on][down] - z[down], 1e-300)).min())
            x[on] += step * (z - x[on])
            x[on[x[on] <= 1e-12]] = 0
            active &= x > 0
            if not active.any():
                break
    return x * scale


def plan_repeats(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats), rounded and limited to the rests there are."""
    combos = combinations(len(histogram))
    x = solve_nnls(combos, histogram.astype(float))
    left = histogram.astype(np.int64).copy()
    found = []
    for j in sorted(np.flatnonzero(x > 0).tolist(), key=lambda j: (-x[j], j)):
        need = np.bincount([c - 1 for c in combos[j]], minlength=len(left))
        most = int((left[need > 0] // need[need > 0]).min())
        repeats = min(int(round(x[j])), most)
        if repeats:
            found.append((combos[j], repeats))
            left -= repeats * need
    return found


# -- distributed running sums --------------------------------------------------------------

def running_sum(df: DataFrame, by: list[str], chunk: Column, order: str, value: Column,
                out: str) -> DataFrame:
    """df with `out`: the sum of value over the rows before it in its `by` group, in order of
    (chunk, order). Chunks are summed first (map-side combined), so a group of any size is
    ordered chunk by chunk in parallel. `order` must be unique, or ties be alike."""
    cut = df.withColumns({"_chunk": chunk, "_value": value})
    keys = [*by, "_chunk"]
    sums = cut.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (cut.join(sums, keys)
            .withColumn(out, F.col("_before") + F.sum("_value").over(within) - F.col("_value"))
            .drop("_chunk", "_value", "_before"))


# -- operator ------------------------------------------------------------------------------

def pack_pieces(lengths: DataFrame, rows: int, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """lengths: _row (unique), _n (tokens, positive). Returns (_row, start, length,
    sequence_id, offset), one row a piece; every token is in exactly one."""
    salts = max(64, -(-rows // CHUNK_ROWS))
    lengths = lengths.select("_row", "_n").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    split = lengths.withColumns({
        "_full": F.floor(F.col("_n") / window), "_rest": F.col("_n") % window,
        "_class": F.ceil((F.col("_n") % window) / step).cast("int")})
    rests = split.where(F.col("_rest") > 0).select("_row", "_salt", "_full", "_rest", "_class")
    ranked = checkpointed(running_sum(rests, ["_class"], F.col("_salt"), "_row", F.lit(1), "_rank"))
    counts = {r["_class"]: r["n"] for r in
              ranked.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    histogram = np.array([counts.get(c, 0) for c in range(1, window // step + 1)])

    # intervals of ranks in a class -> combination and slot; ranks beyond them remain
    sequences, used, slots = 0, np.zeros(len(histogram) + 1, dtype=np.int64), []
    for combo, repeats in plan_repeats(histogram):
        for slot, c in enumerate(combo):
            slots.append((c, int(used[c]), int(used[c]) + repeats, sequences, slot))
            used[c] += repeats
        sequences += repeats
    slots += [(c, int(used[c]), 1 << 62, -1, 0) for c in range(1, len(used))]
    places = ranked.sparkSession.createDataFrame(
        slots, "_class int, _from long, _to long, _first long, _slot int")
    placed = ranked.join(F.broadcast(places), "_class").where(
        (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))

    start = F.col("_full") * window
    inside = Window.partitionBy("_sequence").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    fitted = placed.where(F.col("_first") >= 0).withColumn(
        "_sequence", F.col("_first") + F.col("_rank") - F.col("_from"))
    fitted = fitted.select("_row", start.alias("start"), F.col("_rest").alias("length"),
                           F.col("_sequence").alias("sequence_id"),
                           F.coalesce(F.sum("_rest").over(inside), F.lit(0)).alias("offset"))

    # what remains: longest class first, one after another, cut where a window ends
    left = placed.where(F.col("_first") < 0)
    sums = {r["_class"]: r["s"] for r in left.groupBy("_class").agg(F.sum("_rest").alias("s")).collect()}
    begins, total = [], 0
    for c in sorted(sums, reverse=True):
        begins.append((c, total))
        total += sums[c]
    bases = F.broadcast(ranked.sparkSession.createDataFrame(begins, "_class int, _base long"))
    left = running_sum(left.select("_row", "_full", "_rest", "_class", "_rank"), ["_class"],
                       F.floor(F.col("_rank") / CHUNK_ROWS), "_rank", F.col("_rest"), "_at")
    left = left.join(bases, "_class").withColumn("_at", F.col("_at") + F.col("_base"))
    at, end = F.col("_at"), F.col("_at") + F.col("_rest")
    left = left.withColumn("_window", F.explode(F.sequence(
        F.floor(at / window), F.floor((end - 1) / window))))
    begin = F.greatest(at, F.col("_window") * window)
    greedy = left.select("_row", (start + begin - at).alias("start"),
                         (F.least(end, (F.col("_window") + 1) * window) - begin).alias("length"),
                         (F.col("_window") + sequences).alias("sequence_id"),
                         (begin - F.col("_window") * window).alias("offset"))
    sequences += -(-total // window)

    whole = running_sum(split.where(F.col("_full") > 0).select("_row", "_salt", "_full")
                        .withColumn("_all", F.lit(0)), ["_all"], F.col("_salt"), "_row",
                        F.col("_full"), "_number")
    whole = whole.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
    whole = whole.select("_row", (F.col("_k") * window).alias("start"),
                         F.lit(window).cast("long").alias("length"),
                         (F.col("_number") + F.col("_k") + sequences).alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"))
    types = {c: F.col(c).cast("long") for c in ("start", "length", "sequence_id", "offset")}
    return fitted.unionByName(greedy).unionByName(whole).withColumns(types)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bits),
    doc_tokens, sequence_id, offset.

    Null and empty texts have the end id alone. Repeated rows and rows with a null id are
    separate documents. An empty table gives no piece; other columns of docs aren't read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       F.monotonically_increasing_id().alias("_row")).select("doc_id", "_row", "text")
    held = saved(with_ids(rows, "text", tokenizer).withColumn(
        "_n", F.floor(F.octet_length("_ids") / 4).cast("long")))
    lengths = held.select("_row", "_n")
    pieces = pack_pieces(lengths, held.count(), window)
    joined = held.join(pieces.groupBy("_row").agg(F.collect_list(F.struct(
        "start", "length", "sequence_id", "offset")).alias("_pieces")), "_row")
    each = joined.select("doc_id", "_n", "_ids", F.explode("_pieces").alias("p"))
    return each.select(
        "doc_id", F.col("p.start"), F.col("p.length"),
        F.col("_ids").substr((F.col("p.start") * 4 + 1).cast("int"),
                             (F.col("p.length") * 4).cast("int")).alias("ids"),
        F.col("_n").alias("doc_tokens"), F.col("p.sequence_id"), F.col("p.offset"))


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_nnls_packing": op7_nnls_packing}
ORACLES: dict[str, str] = {}
