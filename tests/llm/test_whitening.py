"""Whitening against dense eigenvectors of the whole covariance."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from newslens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, dim string, s string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "n", "d", "s") for i, v in vectors], SCHEMA).repartition(3)


def plain(vectors, components=4):
    """vec_id -> rows as the operator gives them, but for signs."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(len(v) for _, v in kept)
    whole = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (size - len(v))) for i, v in kept]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array(fit, float) - np.array(sums) / n
    cov = c.T @ c / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:components], vecs[:, ::-1][:, :components]
    rows = []
    for i, x in whole:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        z = (np.array(x) - np.array(sums) / n) @ vecs
        for k, e in enumerate(values):
            rows.append((i, k + 1, n, deviation, z[k] / math.sqrt(e) if e > 1e-9 else None, e / np.trace(cov) if np.trace(cov) > 0 else None))
    return rows


def compare(got, want):
    key = lambda r: (repr(r[0]), r[1], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        mine, theirs = ([r for r in x if r[1] == k] for x in (got, want))
        a, b = ([r[4] for r in x] for x in (mine, theirs))
        assert [x is None for x in a] == [x is None for x in b]
        if a[0] is not None:
            assert min(np.abs(np.array(a) - np.array(b)).max(), np.abs(np.array(a) + np.array(b)).max()) < 1e-9
        for x, y in zip(mine, theirs, strict=True):
            assert (x[5] is None) == (y[5] is None) and (x[5] is None or abs(x[5] - y[5]) < 1e-9)
            assert 0 <= x[6] < 1e-9


def vectors(seed, rows, size):
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((size, size))
    data = rng.standard_normal((rows, size)) @ axes * 0.1 + 3
    return [(i, [float(x) for x in v]) for i, v in enumerate(data)]


def test_against_dense_eigenvectors(spark):
    rows = vectors(1, 300, 40)
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]  # copies count once
    rows += [(0, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, [None] * 40), (2002, [float("nan")] * 40), (2003, [float("inf")] + [0.0] * 39)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 4 * (len(rows) - 4)
    compare(got, plain(rows))


@pytest.mark.parametrize("rows", [
    [(1, [0.5, -0.0])],
    [(1, [0.5]), (2, [0.7])],
    [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [3.0, 6.0, 9.0])],
    [(1, [1.0, 2.0]), (2, [1.5]), (3, []), (4, [-3.0, 0.1])],
    [(1, [0.5, -0.25, 0.1])] * 5,
])
def test_few_dimensions_and_little_variance(spark, rows):
    compare(whitening.whiten(frame(spark, rows)).collect(), plain(rows))


def test_nothing_to_fit(spark):
    for rows in ([(1, None)], [(1, [])], [(1, [float("nan")])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0])]).where("vec_id > 5")).collect() == []


def test_numbers_beyond_a_long(spark):
    rows = [(i, [float(x) * 1e17, 1.0 + i]) for i, x in enumerate([0, 1, -2, 1e21])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 8 and all(r.deviation is None and r.identity_error < 1e-9 for r in got)


def test_deviations_are_exact():
    rng = random.Random(3)
    for scale in (10, 10**9, 10**15):
        n, size = rng.randint(1, 1000), 5
        x = [[rng.randint(-scale, scale) for _ in range(size)] for _ in range(20)]
        sums = [rng.randint(-n * scale, n * scale) for _ in range(size)]
        want = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
        got = whitening.deviations(np.array(x), np.array([s // n for s in sums]), np.array([s % n for s in sums]), n)
        assert got == [w if w < 2**63 else None for w in want]


@pytest.mark.parametrize("size", [1, 3, 30, 120])
def test_eigenpairs_from_products(size):
    rng = np.random.default_rng(size)
    for spectrum in (np.sort(rng.random(size))[::-1], np.r_[np.ones(min(3, size)), np.full(max(size - 3, 0), 0.5)], np.geomspace(1, 1e-12, size)):
        q = np.linalg.qr(rng.standard_normal((size, size)))[0]
        matrix = q @ np.diag(spectrum) @ q.T
        values, vecs = whitening.leading(lambda b, m=matrix: m @ b, size)
        assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:4]).max() < 1e-13
        assert np.abs(matrix @ vecs - vecs * values).max() < 1e-13
        assert np.abs(vecs.T @ vecs - np.eye(len(values))).max() < 1e-13


def test_inner_solutions():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    right = rng.standard_normal(30)
    steps = whitening.INNER
    run = whitening.minres(0.3, lambda x: x, right)
    solution = whitening.in_step([run], lambda b: a @ b)[0]
    shifted = a - 0.3 * np.eye(30)
    krylov = np.linalg.qr(np.stack([np.linalg.matrix_power(shifted, i) @ right for i in range(steps)], axis=1))[0]
    best = krylov @ np.linalg.lstsq(shifted @ krylov, right, rcond=None)[0]
    assert np.allclose(solution, best)
