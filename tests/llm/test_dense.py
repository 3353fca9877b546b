"""Shards of near-duplicate fingerprints that no vantage point splits."""

import time
import tracemalloc

import numpy as np
import pytest

from kinetrail.llm import simhash


def ball(n, bits, seed=0):
    """n distinct values within so many bits of one centre."""
    rng = np.random.default_rng(seed)
    centre, found = np.uint64(rng.integers(0, 2**63)), np.zeros(0, np.uint64)
    while len(found) < n:
        values = np.full(2 * n, centre)
        for _ in range(bits):
            values ^= np.uint64(1) << rng.integers(0, 64, 2 * n).astype(np.uint64)
        found = np.unique(np.concatenate([found, values]))
    return rng.permutation(found)[:n]


def brute_classes(points, reach):
    """The least index of each point's component, by all pairs."""
    label = np.arange(len(points))
    while True:
        low = label.copy()
        for k in range(0, len(points), 512):
            i, j = np.nonzero(np.bitwise_count(points[k : k + 512, None] ^ points[None, :]) <= reach)
            np.minimum.at(low, i + k, label[j])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def found_classes(points, home, reach):
    a, b = simhash.shard_links(points, home, reach)
    order = np.sort(points)
    return simhash.forest(len(order), np.searchsorted(order, a), np.searchsorted(order, b))


@pytest.mark.parametrize("reach", [0, 1, 2, 3])
def test_dense_leaves_by_brute_force(monkeypatch, reach):
    monkeypatch.setattr(simhash, "DENSE", 64)
    monkeypatch.setattr(simhash, "VALUES", 5000)
    rng = np.random.default_rng(reach)
    points = np.unique(np.concatenate([ball(600, 3, 1), ball(500, 2, 2), ball(300, 5, 3), rng.integers(0, 2**63, 300).astype(np.uint64)]))
    rng.shuffle(points)
    want = brute_classes(np.sort(points), reach)
    assert np.array_equal(found_classes(points, np.ones(len(points), bool), reach), want) and len(set(want.tolist())) > 5


def test_meetings_link_queries_to_the_leaf_only():
    points = np.sort(ball(900, 4, 4))
    leaf, at = np.arange(0, 900, 3), np.arange(900)
    for reach in (1, 2):
        pairs = [(i, j) for a, b in simhash.meetings(points, at, leaf, reach, most=3000) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert all(np.bitwise_count(points[i] ^ points[j]) <= reach for i, j in pairs)
        near = np.bitwise_count(points[leaf][:, None] ^ points[at][None, :]) <= reach
        i, j = np.nonzero(near)
        want = simhash.forest(900, leaf[i], at[j])
        assert np.array_equal(simhash.forest(900, *map(np.array, zip(*pairs, strict=True))), want)


def test_a_ball_of_a_whole_shard():
    small, large = ball(1 << 16, 4), ball(1 << 18, 4)

    def seconds(points):
        began = time.perf_counter()
        a, b = simhash.shard_links(points, np.ones(len(points), bool))
        return time.perf_counter() - began, a, b

    first, _, _ = seconds(small)
    tracemalloc.start()
    took, a, b = seconds(large)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000_000 and took < 10 * first  # four times the points
    # Every neighbour of some points, found by comparing with all, is in their class.
    order = np.sort(large)
    label = simhash.forest(len(order), np.searchsorted(order, a), np.searchsorted(order, b))
    sample = np.random.default_rng(1).choice(len(order), 300, replace=False)
    for i in sample.tolist():
        near = np.nonzero(np.bitwise_count(order ^ order[i]) <= 2)[0]
        assert len(set(label[near].tolist())) == 1
