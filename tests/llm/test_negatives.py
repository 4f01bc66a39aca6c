from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, uid long, id string, q string, g string, block string, windows string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, *["x"] * 5) for r in rows], SCHEMA)


def brute(rows, positives=5, negatives_=5):
    use = []
    for i, (vec, v, label) in enumerate(rows):
        if vec is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if len(q) * max(map(abs, q)) ** 2 <= 2**59:
            use.append((i, vec, (label + 1) % 10 if vec % 7 == 0 else label, q))
    out = []
    for i, vec, label, q in use:
        if vec % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, o, strict=True)), other, l == label) for j, other, l, o in use if j != i and len(o) == len(q))
        for p, pid, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p]
            out += [(vec, pid, rank + 1, nid, -p, -n) for rank, (n, nid, _) in enumerate(fits[:negatives_])]
    return sorted(out)


def random_rows(seed, n, dim, labels=4, spread=0.3, step=None):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dim)
    v = centre + spread * rng.normal(size=(n, dim))
    v = np.round(v / step) * step if step else v
    return [(int(i * 10), [float(c) for c in x], int(rng.integers(labels))) for i, x in enumerate(v)]


@pytest.mark.parametrize(("dim", "step"), [(5, 0.5), (16, None), (3, 1.0)])
def test_against_brute_force(spark, monkeypatch, dim, step):
    # small blocks and groups, so that several of each meet and ties cross their borders
    monkeypatch.setattr(negatives, "GROUP", 7)
    rows = random_rows(dim, 300, dim, step=step)
    blocks = negatives.pack
    monkeypatch.setattr(negatives, "pack", lambda r: blocks(r, 16))
    got = negatives.query(table(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows) and got


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = random_rows(2, 60, 4) + [
        (100, [1.0, 1.0, 1.0, 1.0], 1), (100, [1.0, 1.0, 1.0, 1.0], 1), (100, [1.0, 0.5, 1.0, 1.0], 2),  # repeated ids
        (None, [1.0] * 4, 1), (900, None, 1), (901, [], 1), (902, [1.0, None, 1.0, 1.0], 1), (903, [nan] * 4, 1), (904, [inf, 1.0, 1.0, 1.0], 1),
        (905, [1e300, 1.0, 1.0, 1.0], 1), (906, [1e9, 1.0, 1.0, 1.0], 1), (907, [1.0] * 4, None), (908, [1.0] * 3, 1), (1000, [0.5] * 3, 1), (910, [0.4] * 3, 2),
        (1100, [0.0] * 4, 3), (1200, [-1.0] * 4, 3), (1201, [1e5] * 4, 3), (1300, [1e5] * 4, 1),
    ]
    got = negatives.query(table(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows) and got
    empty = negatives.query(table(spark, []))
    assert empty.collect() == [] and dict(empty.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def test_copies_and_a_hot_label(spark):
    rows = [(i * 50, [0.5, -0.25, 0.125, 0.7], 0 if i % 3 else 1) for i in range(90)] + random_rows(4, 40, 4, labels=1)
    assert sorted(tuple(r) for r in negatives.query(table(spark, rows)).collect()) == brute(rows)


@given(st.integers(1, 70), st.integers(1, 20), st.integers(1, 1 << 20), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_planes(n, d, top, seed):
    q = np.random.default_rng(seed).integers(-top, top, (n, d))
    planes = negatives.sliced(q)
    assert (negatives.integers(planes.tobytes(), n, d) == q).all()
    a = np.random.default_rng(seed + 1).integers(-top, top, (6, d))
    whole = a @ q.T
    low, high = np.sort(np.random.default_rng(seed + 2).integers(whole.min() - 1, whole.max() + 2, (2, 6)), axis=0)
    alive = np.random.default_rng(seed + 3).random(whole.shape) < 0.7
    i, j, score = negatives.progressive(a, negatives.bits(planes.tobytes(), n, d), alive.copy(), low, high)
    expected = {(x, y): whole[x, y] for x, y in zip(*np.nonzero(alive & (whole >= low[:, None]) & (whole <= high[:, None])), strict=True)}
    assert dict(zip(zip(i, j, strict=True), score, strict=True)) == expected
    i, j, score = negatives.progressive(a, negatives.bits(planes.tobytes(), n, d), alive.copy(), np.full(6, negatives._LOWEST), np.full(6, 1 << 62), 3)
    for x in range(6):  # no row of the three best is lost
        assert sorted(score[i == x], reverse=True)[:3] == sorted(whole[x][alive[x]], reverse=True)[:3]


def test_candidates_go_early():
    """After the planes that are multiplied for all pairs few are left."""
    rng = np.random.default_rng(1)
    q = np.floor(256 * rng.normal(size=(2048, 64)) / 8).astype(np.int64)
    taken = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                taken.append(len(key))
            return np.asarray(super().__getitem__(key))

    bits = negatives.bits(negatives.sliced(q).tobytes(), 2048, 64)
    rows = [b.view(Counted) for b in bits]
    negatives.progressive(q[:50], rows, np.ones((50, 2048), bool), np.full(50, 30000), np.full(50, 1 << 62))
    assert taken and max(taken) < negatives.SPARSE * 50 * 2048


