"""Exact top-k against all products."""

import math
import random

import numpy as np
import pytest
from forecourt.llm import mtree
from forecourt.llm.mtree import Best, dots, top_k
from helpers import rows_of


def brute_force(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    return rows_of(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), **kw))


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(scale=0.3, size=dim)]) for i in range(n)]


@pytest.mark.parametrize("page, subtree, block", [(512, 32, 256), (16, 2, 4)])
def test_random_vectors(spark, monkeypatch, page, subtree, block):
    for name, value in (("PAGE", page), ("SUBTREE", subtree), ("BLOCK", block), ("GROUP", 2), ("ROWS_PER_PIVOT", 50)):
        monkeypatch.setattr(mtree, name, value)
    rows = vectors(page, 1500)
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, rows[:300], k=3, every=7) == brute_force(rows[:300], 3, 7)


def test_ties_and_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 32)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(600)] + [(600 + i, v[:3]) for i, (_, v) in enumerate(vectors(1, 300))]
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [None, 1.0]), (300, [math.nan, 1.0]), (400, [math.inf, 0.0]), (None, [1.0, 1.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.5]),
            (500, [1.0]), (3, [2.0]), (600, []), (700, [0.0, 0.0]), (800, [1e9, -1e9])]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    twice = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (2, [3.0])]
    assert run(spark, twice) == [(0, 1, 2, 1024 * 3072), (0, 2, 1, 1024 * 2048)]


def test_products_are_exact():
    a = np.array([[2**30, 2**30 - 1], [3, -5]])
    assert dots(a, a).tolist() == [[2**60 + (2**30 - 1) ** 2, 3 * 2**30 - 5 * (2**30 - 1)], [3 * 2**30 - 5 * (2**30 - 1), 34]]


def test_bounds_never_cut_a_product():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-5000, 5000, (200, 8)), rng.integers(-5000, 5000, (30, 8))
    most = float((x**2).sum(1).max())
    d = mtree.distances(q, np.zeros(30), x, mtree.extra(x, most))
    norms = (q.astype(float) ** 2).sum(1)
    exact = dots(q, x)
    assert (mtree.reach(norms[:, None], most, d) >= exact).all()
    parents = mtree.distances(x, mtree.extra(x, most), x[:1], mtree.extra(x, most)[:1])[:, 0]
    gap = np.abs(d[:, :1] - parents)
    assert (gap <= d + 1e-6).all() and (mtree.reach(norms[:, None], most, gap - 1e-6 * (1 + parents)) >= exact).all()


def test_best_keeps_ties_by_id():
    best = Best(np.array([7]), np.array([-100]), 2)
    best.add(0, np.array([5, 5, 9]), np.array([4, 3, 7]))
    best.add(0, np.array([5, 4]), np.array([1, 0]))
    assert best.found[0].tolist() == [1, 3] and best.least.tolist() == [5]
