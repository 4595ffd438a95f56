"""Embedding near-duplicates by int8 tile products with error bounds.

Vectors with one label are dealt to tiles, and each pair of tiles is one group of work.
There, unit vectors are quantised to int8 with a scale of their own, and one integer matrix
product gives all approximate cosines of a block. With x = s q + e, the true cosine differs
from s_x s_y (q_x . q_y) by at most |e_x| + (1 + |e_x|) |e_y|; only pairs which that bound
can lift to the threshold are computed again in double precision. No pair is lost.

Equal vectors are one class before tiles are made, and a group of work gives one row a
linked class (its links, weighted by copies, and the least class reachable in the group),
so dense groups never become lists of pairs. The products themselves grow with the square
of a label's distinct vectors, as the method does; they are spread over tile pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .components import components, local_roots

TILE = 1024
BLOCK = 256          # rows of a tile multiplied at once
RECOMPUTED = 1 << 15  # pairs computed again at once
EXACT_DIMS = 1000    # 127 * 127 * dims stays exact in a float32 product up to here


class Quantised:
    """Vectors of one tile pair: int8 codes, scales, residual norms, and the full vectors."""

    def __init__(self, x: np.ndarray):
        # a power of two brings each row near 1 without rounding, so squares can't overflow
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
        self.full = x
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        unit = x / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rest = unit - self.scale[:, None] * self.codes
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) * (1 + 1e-12) + 1e-12

    def approximate(self, rows: slice, cols: slice) -> np.ndarray:
        total = 0.0
        for d in range(0, self.codes.shape[1], EXACT_DIMS):
            part = self.codes[:, d:d + EXACT_DIMS].astype(np.float32)
            total = total + (part[rows] @ part[cols].T).astype(np.float64)
        return total * self.scale[rows, None] * self.scale[None, cols]

    def bound(self, rows: slice, cols: slice) -> np.ndarray:
        e = self.error
        return e[rows, None] + (1 + e[rows, None]) * e[None, cols]

    def cosine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.full[a], self.full[b]) / (self.norm[a] * self.norm[b])


def linked_pairs(q: Quantised, first: int, same: bool, threshold: float
                 ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose cosine reaches the threshold. The first `first` places are one
    tile, the rest the other; same: there is one tile only, and pairs are a < b."""
    n = len(q.norm)
    cols = slice(0, n) if same else slice(first, n)
    for begin in range(0, first, BLOCK):
        rows = slice(begin, min(begin + BLOCK, first))
        able = q.approximate(rows, cols) + q.bound(rows, cols) >= threshold
        a, b = np.nonzero(able)
        a, b = a + rows.start, b + cols.start
        if same:
            a, b = a[b > a], b[b > a]
        for k in range(0, len(a), RECOMPUTED):
            i, j = a[k:k + RECOMPUTED], b[k:k + RECOMPUTED]
            near = q.cosine(i, j) >= threshold
            yield i[near], j[near]


def _search(group: pa.Table, threshold: float) -> pa.Table:
    group = group.sort_by([("_second", "ascending"), ("_rep", "ascending")]).combine_chunks()
    reps = group.column("_rep").to_numpy()
    copies = group.column("_copies").to_numpy()
    vectors = group.column("_vector").chunk(0) if group.num_rows else None
    out = {"_rep": reps[:0], "_links": reps[:0], "_root": reps[:0]}
    if group.num_rows:
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        q = Quantised(x.reshape(len(reps), -1))
        second = group.column("_second").to_numpy(zero_copy_only=False)
        same = group.column("_i")[0].as_py() == group.column("_j")[0].as_py()
        first = len(reps) if same else int((~second).sum())
        links = np.zeros(len(reps), dtype=np.int64)

        def counted():
            for a, b in linked_pairs(q, first, same, threshold):
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                yield a, b

        root = least_roots(reps, counted())
        on = links > 0
        out = {"_rep": reps[on], "_links": links[on], "_root": root[on]}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def least_roots(reps: np.ndarray, pairs) -> np.ndarray:
    """The least representative reachable from each place."""
    root = local_roots(len(reps), pairs)
    least = reps.copy()
    np.minimum.at(least, root, reps)
    return least[root]


def embedding_components(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                         label: str = "label", threshold: float = 0.93,
                         tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of df.

    Rows link if their labels are equal and not null, their vectors have as many components,
    and the cosine in double precision is at least `threshold`. Vectors that are null, empty,
    zero or hold a null or non-finite component, and rows with a null label, link with
    nothing. Repeated rows link with each other like any equal vectors, and rows without an
    id link like any other; they name a component (null) only if no row of it has an id, and
    count as one id, so kept holds for all of them there. An empty table stays empty; other
    columns of df are not read.
    """
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("_label"),
                     F.col(vector).cast("array<double>").alias("_vector"))
    finite = F.forall("_vector", lambda v: F.coalesce(
        ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    usable = (F.col("_label").isNotNull() & F.coalesce(finite, F.lit(False))
              & F.coalesce(F.exists("_vector", lambda v: v != 0), F.lit(False)))
    rows = rows.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    some = rows.where("_usable")
    # a class has a key of its own, written once: ids may be null, or repeat over classes
    classes = checkpointed(some.groupBy("_label", "_vector").agg(
        F.min("vec_id").alias("_least"), F.count("*").alias("_copies"))
        .withColumn("_rep", F.monotonically_increasing_id()))

    own = ["_label", "_dim"]
    sized = classes.withColumn("_dim", F.size("_vector"))
    counts = sized.groupBy(*own).agg(F.ceil(F.count("*") / F.lit(tile)).alias("_tiles"))
    placed = sized.join(counts, own).withColumn(
        "_tile", F.pmod(F.xxhash64("_rep"), F.col("_tiles")))
    # each pair of tiles i <= j once; a row goes to all pairs of its tile
    work = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))) \
        .select(*own, F.least("_tile", "_other").alias("_i"), F.greatest("_tile", "_other").alias("_j"),
                (F.col("_tile") > F.col("_other")).alias("_second"), "_rep", "_copies", "_vector")
    found = checkpointed(work.groupBy(*own, "_i", "_j").applyInArrow(
        lambda group: _search(group, threshold), "_rep long, _links long, _root long"))

    links = found.groupBy("_rep").agg(F.sum("_links").alias("_links"))
    roots = components(found.select(F.col("_rep").alias("a"), F.col("_root").alias("b")))
    named = (classes.join(links, "_rep", "left")
             .join(roots.withColumnRenamed("node", "_rep"), "_rep", "left")
             .select("_label", "_vector", "_least", F.coalesce("root", "_rep").alias("_root"),
                     (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links")))
    names = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = named.join(names, "_root")
    linked = some.join(named, ["_label", "_vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("_usable")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


# cosines are computed per pair here: right, but with all pairs of a label at once
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e)
        / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(node, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS m FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links,
       least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.node = e.vec_id
"""

QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
ORACLES = {"op8_embedding_dedup": ORACLE}
