"""Operator 13 against numpy's dense eigenvalues and Python's exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from civicspark.llm.whitening import above, deviations, fit_whitening, inertia, leading, op13_whitening, scaled, whitened


def symmetric(d, seed):
    a = np.random.default_rng(seed).normal(size=(d, d))
    return a + a.T


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_counts_of_negative_eigenvalues(d):
    for seed in range(20):
        a = symmetric(d, seed)
        for s in (0.0, 0.3, -1.0):
            assert inertia(a - s * np.eye(d)) == int((np.linalg.eigvalsh(a) < s).sum())
    assert inertia(np.zeros((d, d))) == 0 and inertia(-np.eye(d)) == d
    assert inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1  # no pivot on the diagonal


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1e8, 1, 1e-3, 1e-9, 0], [3, 3, 3, 1, 1], [2, 2 - 1e-9, 2 - 2e-9, 1, 0.5], [1, 0, 0, 0, 0], [7, 7 - 1e-14, 1, 1, 1]])
def test_leading_pairs(values):
    q, _ = np.linalg.qr(symmetric(len(values), 5))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    got, vectors = leading(v)
    want = [x for x in sorted(values, reverse=True)[:4] if x > 1e-14 * max(values)]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-13 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-10)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * max(values)
    for k, value in enumerate(got):
        assert above(v, value - 1e-11 * max(values)) > k


def test_no_eigenvalues():
    assert leading(np.zeros((3, 3)))[0].size == 0 and leading(np.zeros((0, 0)))[0].size == 0


def test_exact_deviations_in_machine_and_long_integers():
    rng = np.random.default_rng(1)
    for size, n in ((1000, 50), (1 << 29, 50), (1 << 40, 10**6)):
        rows = rng.integers(-size, size, (20, 4))
        sums = np.array([int(x) for x in rows.sum(axis=0)], object)
        want = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, sums)) for row in rows]
        assert deviations(rows, n, sums) == [w if w < 1 << 63 else None for w in want]


def plain(rows):
    """(n, sums, covariance) of the distinct integer vectors."""
    x = sorted({tuple(math.floor(256 * c) for c in v) for v in rows})
    m = np.array(x, float)
    return len(x), m.sum(axis=0), np.cov(m.T, bias=True).reshape(m.shape[1], -1), {v: i for i, v in enumerate(x)}


def test_query_against_dense_decomposition(spark, small):
    given = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    n, sums, v, _ = plain(given.values())
    values, vectors = np.linalg.eigh(v)
    rows = op13_whitening(spark, small).collect()
    assert len(rows) == 4 * len(given)
    signs = {}
    for r in rows:
        x = np.array([math.floor(256 * c) for c in given[r.vec_id]], float)
        e, w = values[-r.component], vectors[:, -r.component]
        want = (x - sums / n) @ w / math.sqrt(e)
        sign = signs.setdefault(r.component, 1 if want * r.whitened > 0 else -1)
        assert abs(sign * r.whitened - want) < 1e-9
        assert r.n == n and abs(r.explained - e / np.trace(v)) < 1e-12 and r.identity_error < 1e-9
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))


def test_odd_vectors(spark):
    good = [[0.5, 1.0, -0.25], [0.5, 1.0, -0.25], [2.0, 0.0, 1.0], [-1.0, 3.0, 0.125]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows = [(None if k == 2 else 7, v, "x", 3) for k, v in enumerate(good)] + [(k, v, "y", 4) for k, v in enumerate(bad)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, component int")
    x = scaled(given)
    got = whitened(x, fit_whitening(x)).collect()
    assert sorted((r.vec_id is None, r.component) for r in got) == sorted([(False, 1), (False, 2)] * 3 + [(True, 1), (True, 2)])  # three points span two dimensions
    n, sums, *_ = plain(good)
    assert {r.n for r in got} == {n} == {3}
    assert {r.deviation for r in got} == {sum((n * math.floor(256 * c) - int(s)) ** 2 for c, s in zip(v, sums)) for v in good}
    assert max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("rows", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]] * 3, [None]])
def test_tables_without_a_component(spark, rows):
    x = scaled(spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "vec_id long, embedding array<float>"))
    assert whitened(x, fit_whitening(x)).count() == 0
