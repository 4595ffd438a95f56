"""SimHash near-duplicates over a Gray-order hierarchical index.

A hierarchical index answers all fingerprints of a group at once: they are sorted by their
rank in Gray order, in which neighbours share most bits; runs of neighbours become nodes that
factor out the bits their members share (a mask and a pattern), and upper nodes do the same
for runs of nodes. A search walks down from the top, adds up the bits in which the query differs
from what a node's members newly share, and drops the whole node once these exceed the distance.

One index over all fingerprints would have to stand in one task, so they are dealt to groups
of some `GROUP_ROWS` first, without losing a pair: fingerprints that differ in at most `distance`
bits agree on at least one of distance + 1 blocks of bits, so each is dealt once per block to the
group of that block's first bits, as many as make groups of that size (none for a small table: it
is one index). A group that is `HOT` times as large is dealt on: the bits it hasn't fixed yet are
cut into blocks again. So every fingerprint is searched through an index, at a cost that doesn't
grow with the table.

Links of a group go out as a spanning star of each of its components (all members to the
least), so that copies and near copies never become all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, small_batches, table
from .components import components, local_roots

BITS = 64
FAN = 16          # members of a node
GROUP_ROWS = 2048  # fingerprints in a group, on average
HOT = 4            # times that many: the group is dealt on
PAIRS = 2_000_000  # queries x nodes compared at once


# -- fingerprints ------------------------------------------------------------------------

def shingles(text: str, words: int) -> list[bytes]:
    """Lower-cased (A-Z) word runs, repeats included; a shorter text is one run, an empty
    one none. Words end at ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    whole = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    begins = [0, *ends[:-words].tolist()]
    return [whole[b:e] for b, e in zip(begins, (ends[words - 1:] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, words: int) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes; no word gives 0."""
    runs = shingles(text or "", words)
    if not runs:
        return 0
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(r, 42) for r in runs], dtype="<u8")
    bits = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, words: int, text: str = "text") -> DataFrame:
    """df without its text, with the long column _fp (the 64 bits as a signed number)."""
    kept = [c for c in df.columns if c not in (text, "_fp")]
    df = df.select(*kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in
                               batch.column(len(kept)).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))],
                                             names=[*kept, "_fp"])

    fields = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("_fp", T.LongType())]))


# -- the index ---------------------------------------------------------------------------

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Levels of (mask, pattern) over Gray-sorted fingerprints; level 0 are the codes. A
    level's mask are the bits that its nodes' members share, less those that their parents'
    already do: differences add up on the way down. visited and pruned count nodes by level."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [(full, self.codes)]
        self.fan = fan
        while len(self.levels[-1][0]) > fan:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), fan)
            # bits that all members fix, and fix alike
            ones = np.bitwise_and.reduceat(pattern, at)
            zeros = np.bitwise_and.reduceat(~pattern & mask, at)
            self.levels.append((ones | zeros, ones))
        self.visited, self.pruned = np.zeros((2, len(self.levels)), dtype=np.int64)
        # what a level's nodes share beyond their parents
        shared = [mask for mask, _ in self.levels]
        self.fresh = [m & ~shared[k + 1][np.arange(len(m)) // fan] if k + 1 < len(shared) else m
                      for k, m in enumerate(shared)]

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in self.codes) of a < b at most `distance` bits apart, in bounded blocks."""
        top = len(self.levels) - 1
        width = max(1, PAIRS // (self.fan * max(1, len(self.levels[top][0]))))
        for begin in range(0, len(self.codes), width):
            query = np.arange(begin, min(begin + width, len(self.codes)))
            nodes = len(self.levels[top][0])
            yield from self._down(top, np.repeat(query, nodes), np.tile(np.arange(nodes), len(query)),
                                  np.zeros(nodes * len(query), dtype=np.uint8), distance)

    def _down(self, level: int, query: np.ndarray, node: np.ndarray, gap: np.ndarray, distance: int):
        """gap: the bits in which each query already differs from the node's parents."""
        mask, pattern = self.fresh[level], self.levels[level][1]
        if level:
            # a pair is found from its first member: nodes wholly before it hold no other
            span = self.fan ** level
            keep = (node + 1) * span > query
            query, node, gap = query[keep], node[keep], gap[keep]
        gap = gap + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node])
        near = gap <= distance
        self.visited[level] += len(near)
        self.pruned[level] += len(near) - np.count_nonzero(near)
        query, node, gap = query[near], node[near], gap[near]
        if not level:
            later = node > query
            if later.any():
                yield query[later], node[later]
            return
        below = len(self.levels[level - 1][0])
        for k in range(0, len(query), max(1, PAIRS // self.fan)):
            q, n, g = (x[k:k + max(1, PAIRS // self.fan)] for x in (query, node, gap))
            child = (n[:, None] * self.fan + np.arange(self.fan)).ravel()
            q, g = np.repeat(q, self.fan), np.repeat(g, self.fan)
            there = child < below
            yield from self._down(level - 1, q[there], child[there], g[there], distance)


def group_links(values: np.ndarray, offsets: np.ndarray, distance: int, fan: int = FAN):
    """Spanning star links (member, least member) within each group of distinct fingerprints:
    group k holds values[offsets[k]:offsets[k + 1]]."""
    codes = values.view(np.uint64)
    sizes = np.diff(offsets)

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # a group of one node needs no levels: its members are compared in blocks of groups
        for n in range(2, fan + 1):
            first, second = np.triu_indices(n, 1)
            begins = offsets[:-1][sizes == n]
            for k in range(0, len(begins), PAIRS // len(first)):
                at = begins[k:k + PAIRS // len(first), None]
                a, b = (at + first).ravel(), (at + second).ravel()
                near = np.bitwise_count(codes[a] ^ codes[b]) <= distance
                yield a[near], b[near]
        for k in np.flatnonzero(sizes > fan).tolist():
            index = GrayIndex(codes[offsets[k]:offsets[k + 1]], fan)
            for a, b in index.pairs(distance):
                yield index.order[a] + offsets[k], index.order[b] + offsets[k]

    root = local_roots(len(codes), found())
    linked = np.flatnonzero(root != np.arange(len(codes)))
    return values[linked], values[root[linked]]


# -- dealing -----------------------------------------------------------------------------

def path_bits(path: str, parts: int) -> list[int]:
    """The bits that a path of block choices fixes: each choice takes one of `parts` blocks
    of the bits still free, or ("block:n") its first n bits."""
    free, fixed = list(range(BITS)), []
    for step in path.split("."):
        choice, _, width = step.partition(":")
        cut = [round(k * len(free) / parts) for k in range(parts + 1)]
        block = free[cut[int(choice)]:cut[int(choice) + 1]]
        block = block[:int(width)] if width else block
        fixed += block
        free = [b for b in free if b not in block]
    return fixed


def dealt(df: DataFrame, distance: int, width: int | None = None) -> DataFrame:
    """Each row (_fp, _path, _fixed) to distance + 1 rows with a longer path, by whole blocks or
    their first `width` bits; with no bit, to one row: all in one group."""
    parts = distance + 1
    choices = ["0:0"] if width == 0 else [str(k) if width is None else f"{k}:{width}" for k in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy()
            paths = np.array(batch.column(1).to_pylist(), dtype=object)
            for path in sorted(set(paths.tolist())):
                own = codes[paths == path]
                for choice in choices:
                    longer = f"{path}.{choice}" if path else choice
                    mask = np.uint64(sum(1 << b for b in path_bits(longer, parts)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own), pa.array([longer] * len(own), pa.string()),
                         pa.array((own.view(np.uint64) & mask).view(np.int64))],
                        names=["_fp", "_path", "_fixed"])

    return df.select("_fp", "_path").mapInArrow(run, "_fp long, _path string, _fixed long")


def fingerprint_links(prints: DataFrame, distance: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Spanning links (a, b) among the distinct fingerprints of `prints` (column _fp).

    Groups over HOT times `group_rows` are dealt on until none is left: a group holds at most
    2 ** (bits not fixed) distinct fingerprints, so this ends.
    """
    width = max(0, math.ceil(math.log2(max(1, prints.count()) / group_rows)))
    groups = checkpointed(dealt(prints.select("_fp", F.lit("").alias("_path")), distance,
                                width if width < BITS // (distance + 1) else None))
    done = None
    while True:
        sizes = groups.groupBy("_path", "_fixed").agg(F.count("*").alias("_n"))
        hot = checkpointed(sizes.where(F.col("_n") > HOT * group_rows).drop("_n"))
        if hot.isEmpty():
            break
        cold = groups.join(hot, ["_path", "_fixed"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        groups = checkpointed(dealt(groups.join(hot, ["_path", "_fixed"], "left_semi"), distance))
    groups = groups if done is None else done.unionByName(groups)
    lists = (groups.groupBy("_path", "_fixed").agg(F.collect_list("_fp").alias("_fps"))
             .where(F.size("_fps") > 1).select("_fps"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy()
            a, b = group_links(values[offsets[0]:offsets[-1]],
                               (offsets - offsets[0]).astype(np.int64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return lists.mapInArrow(search, "a long, b long")


# -- operator ----------------------------------------------------------------------------

def simhash_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       words: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of df: the fingerprint of its whole
    text in 16 hex digits, and the least id reachable over fingerprints at most `distance`
    bits apart.

    Null and empty texts, and texts of white space, have no word: fingerprint zero, linked
    like any other. Equal texts share a fingerprint and so a component. A null id stays
    null and names no component unless all its ids are null; an empty table stays empty;
    other columns of df are not read.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = checkpointed(with_fingerprint(docs, words))
    # one row a fingerprint, with its least id: copies meet here, map-side combined
    distinct = checkpointed(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least")))
    rooted = components(fingerprint_links(distinct, distance))
    known = distinct.join(rooted.withColumnRenamed("node", "_fp"), "_fp", "left") \
        .withColumn("root", F.coalesce("root", "_fp"))
    least = known.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = known.join(least, "root").select("_fp", "component_id")
    return prints.join(named, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
ORACLES: dict[str, str] = {}
