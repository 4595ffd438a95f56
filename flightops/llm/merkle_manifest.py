"""Merkle dataset manifest with checkpoint-and-recompute proofs.

A leaf is the sha256 of a row's fields. The leaves of a source, ascending by id, form a tree
of fan-out 16 whose last node is the source's subroot; the subroots, ascending by source,
form the tree of the root. Only every third level of a tree is stored (`STRIDE`), a node for
each 4,096 below it. A proof needs the levels between as well: the task that holds an aligned
subtree builds them again from the 4,096 stored nodes, writes the siblings of each of these
into its path, and drops them.

Places: rows are dealt to ranges of (source, id, leaf, row number), sorted in each range, and
numbered by the range's offset in its source (a running sum over one row a range and source).
So a source with a third of all rows, or a row repeated a million times, spreads over tasks.
Every group that meets in a task is one aligned subtree, 4,096 nodes at most, with the path of
its top. A path holds at most 15 siblings a level: some 1 KB a level, 9 levels at 10^10 rows.

Defined results: null fields are `-`; rows equal in all fields are leaves of their own, side by
side; leaves of equal ids ascend by digest, null ids stand first; an empty table gives no rows.
Extra columns are ignored (of clashing names none is read). Long texts are hashed whole in the
JVM. A row without an id isn't tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

FANOUT = 16
STRIDE = 3
SPAN = FANOUT ** STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<left:string,right:string>>"


def field_code(column: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value: no two rows share an encoding."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_code(c) for c in columns]).cast("binary"), 256)


def numbered(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """nodes with `_place` (from 0 inside its group, by `order`) and `_n`, the group's size.
    The groups' columns must not be null. Equal rows get different places."""
    spark = nodes.sparkSession
    nodes = saved(nodes.withColumn("_row", F.monotonically_increasing_id()))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order, "_row"]
    dealt = nodes.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = saved(dealt.withColumn("_range", F.spark_partition_id())
                  .withColumn("_seen", F.monotonically_increasing_id()))
    parts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_rows"), F.min("_seen").alias("_first"))
    inside = Window.partitionBy(*group)
    parts = parts.select(
        *group, "_range", "_first",
        F.coalesce(F.sum("_rows").over(inside.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_rows").over(inside).alias("_n"))
    return (dealt.join(parts, [*group, "_range"])
            .withColumn("_place", F.col("_before") + F.col("_seen") - F.col("_first"))
            .drop("_row", "_range", "_seen", "_first", "_before"))


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def interior(nodes: list[str], size: int) -> list[list[str]]:
    """The levels of one aligned subtree, `nodes` first: up to STRIDE levels above them, or
    fewer where the whole tree (of `size` nodes on this level) ends before."""
    levels = [nodes]
    for _ in range(STRIDE):
        if size <= 1:
            break
        below = levels[-1]
        levels.append([_digest(*below[k:k + FANOUT]) for k in range(0, len(below), FANOUT)])
        size = -(-size // FANOUT)
    return levels


def siblings(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """(left, right) siblings of the node at `place`, level by level below the subtree's top."""
    path = []
    for below in levels[:-1]:
        start = place // FANOUT * FANOUT
        path.append(("".join(below[start:place]), "".join(below[place + 1:start + FANOUT])))
        place //= FANOUT
    return path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = _digest(left, leaf, right)
    return leaf


def _sorted_block(block: pa.Table) -> dict[str, list]:
    return block.sort_by("_place").to_pydict()


def _tops(block: pa.Table) -> pa.Table:
    """One stored node for an aligned subtree of stored nodes."""
    got = _sorted_block(block)
    top = interior(got["node"], got["_n"][0])[-1][0]
    return pa.table({"_group": [got["_group"][0]], "_place": pa.array([got["_block"][0]], pa.int64()),
                     "_n": pa.array([-(-got["_n"][0] // SPAN)], pa.int64()), "node": [top]})


def _blocks(level: DataFrame) -> DataFrame:
    return level.withColumn("_block", F.floor(F.col("_place") / SPAN).cast("long"))


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """nodes: _group, _place, _n, node. The stored levels, lowest first; the last has one
    node a group, the group's root."""
    levels = [nodes]
    most = nodes.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        up = _blocks(levels[-1].select("_group", "_place", "_n", "node")).groupBy("_group", "_block")
        levels.append(saved(up.applyInArrow(_tops, "_group string, _place long, _n long, node string")))
        most = -(-most // SPAN)
    return levels


def _paths(block: pa.Table, above: pa.Table) -> Iterator[tuple[dict, list[str], list[list[tuple[str, str]]], dict]]:
    got, top = _sorted_block(block), above.to_pydict()
    levels = interior(got["node"], got["_n"][0])
    upper = [(p["left"], p["right"]) for p in top["path"][0]]
    return got, [siblings(levels, k) + upper for k in range(len(got["node"]))], top


def _down(block: pa.Table, above: pa.Table) -> pa.Table:
    """The path of every stored node of an aligned subtree, below its top's path."""
    got, paths, top = _paths(block, above)
    n = len(paths)
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.table({"_group": got["_group"], "_block": pa.array(got["_place"], pa.int64()),
                     "path": pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], kind),
                     "subroot": pa.array(top["subroot"] * n, pa.string()), "root": pa.array(top["root"] * n, pa.string())})


_ABOVE = f"_group string, _block long, path {PATH}, subroot string, root string"


def paths_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tops: _group, _block (0), path, subroot, root, a row a group: the path of its root. The
    paths of the tops of the lowest level's aligned subtrees, regenerated level by level."""
    above = tops
    for level in levels[:0:-1]:
        above = saved(_blocks(level).groupBy("_group", "_block").cogroup(
            above.groupBy("_group", "_block")).applyInArrow(_down, _ABOVE))
    return above


def _prove(block: pa.Table, above: pa.Table) -> pa.Table:
    """Digest of each leaf's siblings, and the root folded from the leaf as found."""
    got, paths, top = _paths(block, above)
    n = len(paths)
    return pa.table({
        "doc_id": pa.array(got["doc_id"], pa.int64()), "leaf": got["node"],
        "subroot": pa.array(top["subroot"] * n, pa.string()), "root": pa.array(top["root"] * n, pa.string()),
        "proof_sha256": [_digest(*[s for pair in p for s in pair]) for p in paths],
        "folded_root": [fold(leaf, p) for leaf, p in zip(got["found"], paths, strict=True)]})


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves: doc_id, source, leaf, found (the leaf to prove, `leaf` where nothing changed).
    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    # '-' sorts before ':' so that the group without a source stands first
    group = F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("-"))
    rows = leaves.select(group.alias("_group"), "doc_id", F.col("leaf").alias("node"), "found")
    rows = saved(numbered(rows, ["_group"], ["doc_id", "node"]))
    trees = stored_levels(rows)
    subroots = numbered(trees[-1].select(F.lit("").alias("_group"), F.col("_group").alias("_source"), "node"),
                        ["_group"], ["_source"])
    subroots = saved(subroots)
    forest = stored_levels(subroots)
    root = forest[-1].select("_group", F.lit(0).cast("long").alias("_block"), F.expr(f"cast(array() as {PATH})").alias("path"),
                             F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    upper = paths_down(forest, root)
    # the lowest step by hand: its rows keep their source
    tops = _blocks(subroots).groupBy("_group", "_block").cogroup(upper.groupBy("_group", "_block")).applyInArrow(
        _source_tops, _ABOVE)
    below = paths_down(trees, saved(tops))
    out = _blocks(rows).groupBy("_group", "_block").cogroup(below.groupBy("_group", "_block")).applyInArrow(
        _prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _source_tops(block: pa.Table, above: pa.Table) -> pa.Table:
    got, paths, top = _paths(block, above)
    n = len(paths)
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.table({"_group": got["_source"], "_block": pa.array([0] * n, pa.int64()),
                     "path": pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], kind),
                     "subroot": got["node"], "root": pa.array(top["root"] * n, pa.string())})


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; where 5 divides crc32 of the id as text, the text found has its A-Z
    lower-cased, and the proof fails exactly there where that changes the text."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = F.when(bad, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    plain = [F.col(c) for c in FIELDS]
    return manifest(docs.select("doc_id", "source", leaf_digest(plain).alias("leaf"),
                                leaf_digest([*plain[:-1], found]).alias("found")))


def _oracle() -> str:
    """Levels written out: five of a source's tree, three of the sources' tree (10^6 rows a
    source, 4,096 sources)."""
    code = lambda c: (f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')")
    leaf = lambda text: "sha256(" + " || ".join([*[code(c) for c in FIELDS[:-1]], code(text)]) + ")"
    crc = ("4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform("
           "string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce("
           "list_prepend(xor(a, b), [1::bigint, 2, 3, 4, 5, 6, 7, 8]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))")
    low = f"case when doc_id is not null and ({crc}) % 5 = 0 then translate(text, '{UPPER}', '{LOWER}') else text end"
    sql = [f"base as (select *, {low} as found_text from documents)",
           f"leaves as (select doc_id, coalesce(':' || source, '-') as g, {leaf('text')} as leaf, "
           f"{leaf('found_text')} as found from base)",
           "l0 as (select *, leaf as node, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p, "
           "count(*) over (partition by g) as n from leaves)"]

    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            sql.append(f"{name}{k + 1} as (select g, p // 16 as p, case when max(n) > 1 then "
                       f"sha256(string_agg(node, '' order by p)) else max(node) end as node, "
                       f"(max(n) + 15) // 16 as n from {name}{k} group by g, p // 16)")
    climb("l", 5)
    sql.append("s0 as (select '' as g, g as src, node, row_number() over (order by g) - 1 as p, "
               "count(*) over () as n from l5)")
    climb("s", 3)

    def near(name: str, k: int, place: str, group: str) -> tuple[str, str]:
        """Left and right siblings of the node at `place` on one level."""
        picks = []
        for side in (f"z.p < {place}", f"z.p > {place}"):
            picks.append(f"coalesce((select string_agg(z.node, '' order by z.p) from {name}{k} z "
                         f"where z.g = {group} and z.p // 16 = {place} // 16 and z.n > 1 and {side}), '')")
        return picks[0], picks[1]
    sql.append("p0 as (select l0.doc_id, l0.leaf, l0.found, l0.g, l0.p, s0.p as sp, s0.node as subroot, "
               "(select node from s3) as root, found as cur, '' as proof from l0 join s0 on s0.src = l0.g)")
    last = "p0"
    for step, (name, k) in enumerate([("l", k) for k in range(5)] + [("s", k) for k in range(3)]):
        place = f"(t.{'p' if name == 'l' else 'sp'} // {16 ** k})"
        group = "t.g" if name == "l" else "''"
        left, right = near(name, k, place, group)
        some = (f"(select max(z.n) from {name}{k} z where z.g = {group}) > 1")
        sql.append(f"q{step} as (select t.*, {left} as a, {right} as b, {some} as up from {last} t)")
        sql.append(f"r{step} as (select * exclude (a, b, up, cur, proof), case when up then sha256(a || cur || b) "
                   f"else cur end as cur, proof || a || b as proof from q{step})")
        last = f"r{step}"
    return (f"with {', '.join(sql)} select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, "
            f"cur as folded_root, cur = root as verified from {last}")


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": _oracle()}
