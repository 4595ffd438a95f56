"""Language-model scoring by deleted interpolation.

P(w | v) = a c(v, w) / c(v) + b c(w) / N + c 1 / (V + 1), with maximum-likelihood counts of
the training documents. The weights (a, b, c) depend on how often the context v was seen (a
bucket for each power of two). They are learned by expectation-maximisation on a part of the
training documents that is deleted from the counts while learning, and added for scoring.

Counts live with their keys, texts live in blocks, and arrays travel between them:

1. tasks turn documents into blocks of some 1.5 million tokens (word numbers local to the
   block), kept as a table in the shared folder;
2. each block asks for its distinct words and word pairs, sorted by hash, cut by hash range;
3. a group for each range adds up the counts of all blocks and answers each of them in the
   order of its request;
4. blocks and answers meet by block, and every document is scored there.

A block asks once for a pair however often it holds it, and a group holds `RANGE_KEYS` keys,
so a pair that makes up a third of all rows is one key a block. Nothing is cut off: rows,
requests and answers grow with the distinct pairs of the blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, saved, small_batches, table

FOLDS, HELD_OUT, DELETED = 10, 0, 1   # remainders of crc32(doc_id as text) mod 10
BLOCK_TOKENS = 1_500_000
RANGE_KEYS = 1_000_000
BUCKETS = 32
ROUNDS = 40
STEPS = 8       # cells of probabilities per power of two, for learning the weights
FLOOR = 1e-5    # least weight of the uniform part: unseen words keep a probability
START, END = 0, 1  # local numbers; words follow
_END_HASH = np.uint64(0x51ED270B9F652295)

BLOCK_SCHEMA = ("block long, deleted boolean, doc_ids array<long>, parts binary, sizes binary, "
                "words binary, tokens binary, n_tokens long")


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


# -- blocks ------------------------------------------------------------------------------

class _Block:
    def __init__(self, deleted: bool):
        self.deleted = deleted
        self.number: dict[bytes, int] = {}
        self.doc_ids: list = []
        self.parts: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id, part: int, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        number = self.number
        ids = [number.setdefault(w, len(number) + 2) for w in words]
        ids.append(END)
        self.doc_ids.append(doc_id)
        self.parts.append(part)
        self.tokens.append(np.array(ids, dtype=np.int32))
        self.n += len(ids)

    def row(self) -> dict:
        one = xxhash.xxh64_intdigest
        words = np.array([one(w) for w in self.number], dtype=np.uint64)
        return {"block": uuid.uuid4().int >> 65, "deleted": self.deleted, "doc_ids": self.doc_ids,
                "parts": pack(np.array(self.parts, dtype=np.int8)),
                "sizes": pack(np.array([len(t) for t in self.tokens], dtype=np.int64)),
                "words": pack(words), "tokens": pack(np.concatenate(self.tokens)),
                "n_tokens": self.n}


def to_blocks(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, part (remainder of the fold). Deleted documents get blocks of
    their own, which alone are read while learning."""
    schema = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()),
                        ("doc_ids", pa.list_(pa.int64())), ("parts", pa.binary()),
                        ("sizes", pa.binary()), ("words", pa.binary()),
                        ("tokens", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {flag: _Block(flag) for flag in (False, True)}
        for batch in batches:
            for doc_id, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flag = part == DELETED
                open_[flag].add(doc_id, part, text)
                if open_[flag].n >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([open_[flag].row()], schema)
                    open_[flag] = _Block(flag)
        for block in open_.values():
            if block.n:
                yield pa.RecordBatch.from_pylist([block.row()], schema)

    return docs.select("doc_id", "text", "part").mapInArrow(run, BLOCK_SCHEMA)


class Tokens:
    """A block read back: tokens, the token before each, and the distinct words and pairs in
    the order of their hashes."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.parts = unpack(row["parts"], np.int8)
        self.sizes = unpack(row["sizes"], np.int64)
        self.words = np.concatenate([np.array([0, _END_HASH], dtype=np.uint64),
                                     unpack(row["words"], np.uint64)])
        self.tokens = unpack(row["tokens"], np.int32).astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.begins] = START
        self.before = before
        pair, self.pair = _distinct(before * len(self.words) + self.tokens)
        v, w = pair // len(self.words), pair % len(self.words)
        # the key of a word has its top bit clear, that of a pair has it set
        top = np.uint64(1 << 63)
        self.word_order = np.argsort(self.words[END:] & ~top, kind="stable") + END
        self.word_keys = (self.words & ~top)[self.word_order]
        keys = _mix(self.words[v], self.words[w]) | top
        self.pair_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_order]

    def part_counts(self) -> list[np.ndarray]:
        """For words then pairs, in key order: counts among kept and among deleted documents."""
        part = np.repeat(self.parts, self.sizes)
        out = []
        for owner, n, order in ((self.tokens, len(self.words), self.word_order),
                                (self.pair, len(self.pair_order), self.pair_order)):
            for on in ((part != HELD_OUT) & (part != DELETED), part == DELETED):
                out.append(np.bincount(owner[on], minlength=n)[order].astype(np.int32))
        return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse; code and place sorted as one number where they fit."""
    n = len(codes)
    bits = max(1, n - 1).bit_length()
    if int(codes.max(initial=0)).bit_length() + bits > 63:
        return np.unique(codes, return_inverse=True)
    both = np.sort((codes << bits) | np.arange(n))
    place, codes = both & ((1 << bits) - 1), both >> bits
    first = np.ones(n, dtype=bool)
    first[1:] = codes[1:] != codes[:-1]
    inverse = np.empty(n, dtype=np.int64)
    inverse[place] = np.cumsum(first) - 1
    return codes[first], inverse


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted keys (63 bits) pass from one of the equal hash ranges to the next."""
    share = (keys & np.uint64((1 << 63) - 1)).astype(np.float64) / float(1 << 63)
    return np.searchsorted(np.minimum((share * ranges).astype(np.int64), ranges - 1),
                           np.arange(ranges + 1))


# -- counting ----------------------------------------------------------------------------

def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def requests(blocks: DataFrame, word_ranges: int, pair_ranges: int) -> DataFrame:
    """(block, part, keys, kept, deleted): a block's keys in one hash range with its counts.
    Parts below word_ranges hold words, the others pairs."""
    schema = "block long, part int, keys binary, kept binary, deleted binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            t = Tokens(row)
            counts = t.part_counts()
            rows = []
            for first, ranges, keys, kept, deleted in (
                    (0, word_ranges, t.word_keys, *counts[:2]),
                    (word_ranges, pair_ranges, t.pair_keys, *counts[2:])):
                cuts = _range_cuts(keys, ranges)
                rows += [(row["block"], first + k, pack(keys[a:b]), pack(kept[a:b]), pack(deleted[a:b]))
                         for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                names=["block", "part", "keys", "kept", "deleted"])

    return blocks.mapInArrow(run, schema)


def answers(asked: DataFrame) -> DataFrame:
    """Adds up each key over all blocks: (block, part, kept, deleted) with the totals in the
    order of the request, and one row a part without block: its distinct keys seen in
    training, their sum, and the sum among kept documents."""
    schema = "block long, part int, kept binary, deleted binary, seen long, total long, kept_total long"

    def add(group: pa.Table) -> pa.Table:
        keys = [unpack(x, np.uint64) for x in group.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = []
        for name in ("kept", "deleted"):
            own = np.concatenate([unpack(x, np.int32) for x in group.column(name).to_pylist()])
            totals.append(np.bincount(place, weights=own, minlength=len(every)).astype(np.int64))
        cuts = np.cumsum([0, *sizes])
        n = group.num_rows
        out = {"block": [*group.column("block").to_pylist(), None],
               "part": [group.column("part")[0].as_py()] * (n + 1)}
        for name, total in zip(("kept", "deleted"), totals, strict=True):
            found = total[place]
            out[name] = [*(pack(found[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)), None]
        both = totals[0] + totals[1]
        for name, value in (("seen", int((both > 0).sum())), ("total", int(both.sum())),
                            ("kept_total", int(totals[0].sum()))):
            out[name] = [*([None] * n), value]
        return pa.table(out, schema=pa.schema([
            ("block", pa.int64()), ("part", pa.int32()), ("kept", pa.binary()),
            ("deleted", pa.binary()), ("seen", pa.int64()), ("total", pa.int64()),
            ("kept_total", pa.int64())]))

    return asked.groupBy("part").applyInArrow(add, schema)


class Counted:
    """The tokens of a block with their counts: of each token, its context and the pair."""

    def __init__(self, left: pa.Table, right: pa.Table, kept_only: bool):
        t = self.tokens = Tokens(left.slice(0, 1).to_pylist()[0])
        parts = sorted(right.select(["part", "kept", "deleted"]).to_pylist(), key=lambda r: r["part"])
        counts = np.concatenate([
            unpack(r["kept"], np.int64) + (0 if kept_only else unpack(r["deleted"], np.int64))
            for r in parts])
        words = np.zeros(len(t.words), dtype=np.int64)
        words[t.word_order] = counts[:len(t.word_keys)]
        words[START] = words[END]  # as many contexts as documents
        pairs = np.empty(len(t.pair_order), dtype=np.int64)
        pairs[t.pair_order] = counts[len(t.word_keys):]
        self.word, self.context = words[t.tokens], words[t.before]
        self.pair = pairs[t.pair]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the power of two below its count."""
    return np.where(context > 0, np.minimum(
        np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


# -- weights -----------------------------------------------------------------------------

NONE = 1 << 20  # the cell of a probability of 0


def _cell(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(STEPS * np.log2(np.where(p > 0, p, 1))).astype(np.int64), NONE)


def _level(cell: np.ndarray) -> np.ndarray:
    return np.where(cell == NONE, 0.0, 2.0 ** (np.where(cell == NONE, 0, cell) / STEPS))


def learn_weights(cells: np.ndarray, uniform: float) -> np.ndarray:
    """(BUCKETS, 3) weights of pair, word and uniform part. cells: rows of (bucket, cell of
    the pair's probability, cell of the word's, tokens) from the deleted documents. A bucket
    that they don't reach takes the weights of all buckets together."""
    def run(own: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = np.stack([_level(own[:, 1]), _level(own[:, 2]), np.full(len(own), uniform)], axis=1)
        n, w = own[:, 3].astype(float), start
        for _ in range(ROUNDS):
            joint = p * w
            w = (n[:, None] * joint / joint.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
        w = np.maximum(w, [0, 0, FLOOR])
        return w / w.sum()

    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    if len(cells):
        weights[:] = run(cells, weights[0])
        for b in range(BUCKETS):
            own = cells[cells[:, 0] == b]
            if len(own):
                weights[b] = run(own, weights[b])
    return weights


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    range_keys: int = RANGE_KEYS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the lower-cased (A-Z) words and one end. Null and empty texts have only the
    end. A null id counts as empty text in the folds. Repeated rows and equal texts are
    separate documents, in the counts too. Without training documents all counts are 0 and
    the model is uniform. An empty table stays empty; other columns aren't read.
    """
    lite = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       id_bucket(doc_id, FOLDS).cast("int").alias("part"))
    blocks = saved(to_blocks(lite))
    n = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    pair_ranges = max(8, -(-n // range_keys))  # at most as many keys as tokens
    asked = requests(blocks, max(2, pair_ranges // 4), pair_ranges)
    told = saved(answers(asked))
    totals = told.where(F.col("block").isNull() & (F.col("part") < max(2, pair_ranges // 4))).agg(
        F.sum("seen"), F.sum("total"), F.sum("kept_total")).first()
    distinct, train, kept = (x or 0 for x in totals)
    uniform = 1.0 / (distinct + 1)
    told = told.where(F.col("block").isNotNull()).select("block", "part", "kept", "deleted")

    def count_cells(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Counted(left, right, kept_only=True)
        pair = np.divide(c.pair, c.context, out=np.zeros(len(c.pair)), where=c.context > 0)
        cells = np.stack([bucket(c.context), _cell(pair), _cell(c.word / max(1, kept))], axis=1)
        cells, n = np.unique(cells, axis=0, return_counts=True)
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(
            ("bucket", "pair", "word", "n"), [*cells.T, n], strict=True)})

    learning = blocks.where("deleted")
    cells = (learning.groupBy("block").cogroup(
        told.join(learning.select("block"), "block", "left_semi").groupBy("block"))
        .applyInArrow(count_cells, "bucket long, pair long, word long, n long")
        .groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")))
    # cells are steps of probabilities, so their number is bounded whatever the input
    weights = learn_weights(np.array([tuple(r) for r in cells.collect()],
                                     dtype=np.int64).reshape(-1, 4), uniform)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Counted(left, right, kept_only=False)
        t = c.tokens
        w = weights[bucket(c.context)]
        pair = np.divide(c.pair, c.context, out=np.zeros(len(c.pair)), where=c.context > 0)
        p = w[:, 0] * pair + w[:, 1] * (c.word / max(1, train)) + w[:, 2] * uniform
        base = np.log10((c.word + 0.1) / (train + 0.1 * (distinct + 1)))
        sums = [np.add.reduceat(x, t.begins) for x in (
            (c.word > 0).astype(np.int64), base, np.log10(p))]
        return pa.table({
            "doc_id": pa.array(t.doc_ids, pa.int64()), "held_out": pa.array(t.parts == HELD_OUT),
            "n_tokens": pa.array(t.sizes), "n_known": pa.array(sums[0]),
            "train_tokens": pa.array(np.full(len(t.sizes), train, dtype=np.int64)),
            "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")


def op6_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_interpolated_lm": op6_interpolated_lm}
ORACLES: dict[str, str] = {}
