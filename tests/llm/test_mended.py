"""Faults that an earlier round had, each by the case that showed it."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from lodestone.llm import html_text, language, passages, subspace


def test_op3_links_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(5)
    v, w = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate([v, v * 1e200, v * 1e-200, v * 1e-308, w, w * 1e300 / np.abs(w).max(), -v * 1e150])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in subspace.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0, True), 1: (3, 0, False), 2: (3, 0, False), 3: (3, 0, False), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True)}


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n)]


def test_op9_repeated_ids_in_every_order(spark):
    shared = passage(1, 200)
    near = list(shared)
    for i in range(20, 200, 30):
        near[i] = "other"
    a, b = " ".join(passage(2, 80) + shared + passage(3, 80)), " ".join(passage(4, 50) + near)
    rows = [(1, a), (3, b), (1, " ".join(passage(5, 300))), (None, a), (1, None), (3, b)]
    want = None
    for order in itertools.permutations(range(4)):
        some = [rows[i] for i in order] + rows[4:]
        got = sorted(map(tuple, passages.repeated_passages(spark.createDataFrame(some, "doc_id long, text string").coalesce(1)).collect()))
        want = want or got
        assert got == want and [r[:2] for r in got] == [(3, 1)] and got[0][2:6] == (50, 250, 80, 280)
    # two texts under one id that share a passage with each other
    both = sorted(map(tuple, passages.repeated_passages(spark.createDataFrame([(7, a), (7, b), (8, "x")], "doc_id long, text string")).collect()))
    assert len(both) == 1 and both[0][:2] == (7, 7)


def test_op6_has_no_cap_on_counts(monkeypatch):
    counts = {7: (1 << 23) + 5, 5: (1 << 23) + 9, 9: 1 << 40, 3: 2, 11: (1 << 23) + 5}
    grams = np.array(sorted(counts), np.uint64)
    monkeypatch.setattr(language, "counted", lambda g: (grams, np.array([counts[int(x)] for x in grams])))
    assert language.ranked("any text").tolist() == [9, 5, 7, 11, 3] and language.ranked("any text", 2).tolist() == [9, 5]


@pytest.mark.parametrize("name", ["social-science", "share-price", "top-notice-period", "signup2024-report", "login-history"])
def test_op2_keeps_what_the_author_named(name):
    page = f'<nav>menu</nav><article><p>{"Long enough text. " * 8}</p><section class="{name}"><p>Short.</p></section><div id="{name}"><p>Also.</p></div></article>'
    assert html_text.extract(page).endswith("\nShort.\nAlso.")


@pytest.mark.parametrize("name", ["ad", "ad-slot-3", "comment-list", "newsletter-signup", "sidebar", "cookie-notice", "related-posts", "social-share"])
def test_op2_leaves_out_what_is_marked(name):
    page = f'<article><p>{"Long enough text. " * 8}</p><div class="{name}"><p>Something else.</p></div><p>End.</p></article>'
    assert "Something" not in html_text.extract(page) and html_text.extract(page).endswith("\nEnd.")


def test_op2_keeps_formulas():
    assert html_text.extract(f"<article><p>{'Long enough text. ' * 8}</p><p>An equation <math><mi>x</mi>=<mn>2</mn></math> and more.</p></article>").endswith("\nAn equation x=2 and more.")
