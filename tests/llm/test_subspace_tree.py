"""The trees that route vectors to the chunks of a block join."""

from __future__ import annotations

import numpy as np

from lodestone.llm import subspace


def boxes(levels, width):
    """(low, high) of each leaf, by cutting boxes level by level."""
    out = [(np.full(width, -np.inf), np.full(width, np.inf))]
    for axis, cut in levels:
        parts = []
        for (low, high), a, c in zip(out, axis, cut, strict=True):
            left, right = high.copy(), low.copy()
            left[a], right[a] = c, c
            parts += [(low, left), (right, high)]
        out = parts
    return out


def test_leaves_within_the_radius_of_a_point():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(4000, 32))
    plan = subspace.Plan(32, 0.9, sample, rows=1 << 20, chunk=4096)
    x = plan.rotated(np.concatenate([rng.normal(size=(200, 32)), sample[:100] * 3]))[1] / subspace.GRID
    some = 0
    for b, cols in enumerate(plan.blocks):
        levels = plan.trees[b]
        assert len(levels) == 8
        got = {(leaf, i) for leaf, at in plan.near(b, x[:, cols]) for i in at.tolist()}
        want = set()
        for leaf, (low, high) in enumerate(boxes(levels, cols.stop - cols.start)):
            off = np.maximum(np.maximum(low - x[:, cols], x[:, cols] - high), 0)
            want |= {(leaf, i) for i in np.flatnonzero((off * off).sum(axis=1) <= plan.budget[b] + subspace.SLACK).tolist()}
        assert got == want
        assert {(leaf, i) for i, leaf in enumerate(plan.leaf(b, x[:, cols]).tolist())} <= got
        some += len(got)
    assert 0 < some < 300 * sum(1 << len(t) for t in plan.trees)


def test_every_pair_of_chunks_near_each_other_meets_once():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    plan = subspace.Plan(16, 0.9, x, rows=500, chunk=40)
    grid = plan.rotated(x)[1]
    leaf = plan.leaf(0, grid / subspace.GRID)
    counts = {(0, k): int(n) for k, n in zip(*np.unique(leaf, return_counts=True), strict=True)}
    top = plan.chunks(counts, 10, 5)
    row, unit, guest = plan.route(np.arange(500), grid)
    home = dict(zip(row[~guest].tolist(), unit[~guest].tolist(), strict=True))
    assert sorted(home) == list(range(500)) and min(unit) >= 5 and max(unit) < top
    visits = list(zip(row[guest].tolist(), unit[guest].tolist(), strict=True))
    assert len(visits) == len(set(visits)) and all(home[r] < u for r, u in visits)
    near = {(i, k) for k, at in plan.near(0, grid / subspace.GRID) for i in at.tolist()}
    units = {k: range(int(plan.first[0][k]), int(plan.first[0][k + 1])) for k in range(len(plan.first[0]) - 1)}
    assert set(visits) == {(i, u) for i, k in near for u in units[k] if u > home[i]}


def test_leaves_grow_with_the_rows_within_the_driver_s_bound():
    assert subspace.sample_size(64, 50_000, 4096) == subspace.LEAST_SAMPLE
    assert subspace.sample_size(64, 1 << 25, 4096) == 1 << 16
    assert subspace.sample_size(64, 1 << 40, 4096) * 64 == subspace.SAMPLE_CELLS
    assert subspace.sample_size(1 << 24, 10, 4096) == 1
    x = np.random.default_rng(4).normal(size=(1 << 16, 16))
    assert [len(subspace.Plan(16, 0.9, x[: subspace.sample_size(16, n, 4096)], n, 4096).trees[0]) for n in (4096, 1 << 20, 1 << 24, 1 << 25)] == [0, 8, 12, 13]
