"""Connected components by alternating large-star and small-star steps.

Input links are pairs of nodes; every step is a grouped minimum (map-side combined) and one
equi-join back, which adaptive execution splits where one node holds many links. The links
are cut from their lineage after each round, and stay in the executors throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v). large: each neighbour above u goes to u's least neighbour (or u).
    small: each neighbour below u, and u, go to the least of them."""
    if large:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (two columns of one orderable type): root is
    the least node reachable. Nodes without links don't occur; self-links, repeated and
    reversed links, and rows with a null are ignored; no links give no rows."""
    a, b = links.columns
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    links = checkpointed(links.distinct())
    mark = None
    while True:
        links = checkpointed(_star(_star(links, True), False))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == mark or not now[0]:
            break
        mark = now
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place reachable from each of n places, by hooking and pointer jumping."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                jumped = root[root]
                if (jumped == root).all():
                    break
                root = jumped
    return root
