"""The Gray-order index is the path of every fingerprint, and prunes whole nodes."""

import numpy as np
import pytest

from flightops.llm import simhash_dedup
from flightops.llm.components import components


def near_prints(rng, n, groups):
    base = rng.integers(0, 1 << 63, groups, dtype=np.uint64)
    codes = base[rng.integers(0, groups, n)]
    for _ in range(2):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(np.concatenate([codes, rng.integers(0, 1 << 63, n, dtype=np.uint64)]))


def test_nodes_are_pruned_and_no_link_is():
    codes = near_prints(np.random.default_rng(1), 6_000, 900)
    index = simhash_dedup.GrayIndex(codes)
    got = {(int(index.codes[x]), int(index.codes[y])) for a, b in index.pairs(3) for x, y in zip(a, b, strict=True)}
    want = set()
    for k in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[k] ^ codes[k + 1:]) <= 3) + k + 1:
            want.add((int(codes[k]), int(codes[j])))
    assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want} and len(got) == len(want) > 1000
    # most pairs of fingerprints are never compared: their nodes went before
    assert len(index.levels) == 4 and index.pruned[1] > 0.5 * index.visited[1]
    assert index.visited[0] < 0.3 * len(codes) ** 2 / 2
    # bits shared at a level are told apart from those that parents share already
    for level in range(len(index.levels) - 1):
        parent = index.levels[level + 1][0][np.arange(len(index.fresh[level])) // index.fan]
        assert not (index.fresh[level] & parent).any()


@pytest.mark.parametrize("rows", [64, 700, 100_000])
def test_links_of_any_group_size_equal_brute_force(spark, monkeypatch, rows):
    codes = near_prints(np.random.default_rng(2), 1_500, 200)
    prints = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "_fp long")
    got = dict(components(simhash_dedup.fingerprint_links(prints, 3, group_rows=rows)).collect())
    pairs = [np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3, 1))]
    root = simhash_dedup.local_roots(len(codes), pairs)
    signed = codes.view(np.int64)
    want = {}
    for r in np.unique(root):
        members = signed[root == r]
        if len(members) > 1:
            want |= {int(m): int(members.min()) for m in members}
    assert got == want


def test_groups_are_large_enough_for_the_index(spark):
    codes = np.random.default_rng(3).integers(0, 1 << 63, 40_000, dtype=np.uint64)
    prints = spark.createDataFrame([(int(c), "") for c in codes.view(np.int64)], "_fp long, _path string")
    width = 5   # 2^5 groups a block at 2,048 rows a group
    sizes = [r["count"] for r in simhash_dedup.dealt(prints, 3, width).groupBy("_path", "_fixed").count().collect()]
    assert len(sizes) == 4 * 2 ** width and min(sizes) > 40 * simhash_dedup.FAN
    assert simhash_dedup.dealt(prints, 3, 0).groupBy("_path", "_fixed").count().count() == 1
    assert simhash_dedup.path_bits("1:3", 4) == [16, 17, 18] and len(simhash_dedup.path_bits("0:2.3", 4)) == 18
