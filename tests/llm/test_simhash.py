"""Shards and trees of fingerprints, hot ones too."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tradewind.llm import simhash


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def plain_roots(values, radius=4):
    """Each value's smallest reachable one (as signed numbers), by all pairs."""
    values = np.array(sorted(set(values)), np.int64)
    root = np.arange(len(values))
    bits = values.view(np.uint64)
    near = [np.flatnonzero(np.bitwise_count(bits ^ b) <= radius) for b in bits]
    changed = True
    while changed:
        new = np.array([root[n].min() for n in near])
        changed = bool((new != root).any())
        root = new
    return {int(v): int(values[r]) for v, r in zip(values, root, strict=True)}


def roots_of(spark, values, radius=4):
    prints = spark.createDataFrame([(v,) for v in set(values)], "fp long").repartition(4)
    found = simhash.components(simhash.near_links(prints, len(set(values)), radius)).collect()
    return {v: v for v in values} | {r.node: r.root for r in found}


@pytest.mark.parametrize("members, levels", [(4096, 3), (16, 3), (16, 1), (4, 0)])
def test_shards_cut_or_not_give_the_same_components(spark, monkeypatch, members, levels):
    monkeypatch.setattr(simhash, "TREE_MEMBERS", members)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(300)]
    centre = rng.getrandbits(64)
    values += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(200)]
    for _ in range(100):
        values.append(rng.choice(values) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = [signed(v) for v in values]
    assert roots_of(spark, values) == plain_roots(values)


def test_pairs_within_the_radius_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_MEMBERS", 4)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), 4)) for b in base]
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    cells = simhash._shards(prints, len(values), 4).collect()
    held = {}
    for r in cells:
        held.setdefault(r.fp, set()).add(r.cell)
    for a, b in zip(base, values[40:], strict=True):
        assert held[signed(a)] & held[signed(b)]


def test_a_hot_shard_takes_rows_in_proportion(spark):
    """Fingerprints that agree on a whole table's bits: cut by further bits, not paired by parts."""
    n = 60_000
    rows = spark.range(n).selectExpr("shiftleft(xxhash64(id), 13) | 5 AS fp").distinct()
    n = rows.count()
    cells = simhash._shards(rows, n, 4)
    sizes = cells.groupBy("cell").count()
    assert cells.count() < 12 * n  # five tables, and five more for the hot shard
    assert sizes.agg({"count": "max"}).first()[0] <= simhash.TREE_MEMBERS
    assert cells.where("NOT tree OR NOT ask").isEmpty()


def test_edges_outside_the_radius_are_not_followed():
    """A query meets the same members as a full comparison, by way of fewer nodes."""
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (2000, 3), dtype=np.uint64)
    values = np.unique(np.bitwise_xor.reduce(flips, axis=1) ^ np.repeat(centres, 100))
    forest = simhash.BKForest(values, np.zeros(len(values), np.int64))
    met = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                met.append(at.size)
            return super().__getitem__(at)

    forest.values = values.view(Watched)
    q, m = forest.within(values, np.zeros(len(values), np.int64), 4)
    pairs = set(zip(q.tolist(), np.asarray(m).tolist(), strict=True))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    assert sum(met) < 0.5 * len(values) ** 2
