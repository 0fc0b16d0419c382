"""Whitening against numpy's eigenvectors."""

import math

import numpy as np
import pytest

from recordspark.llm.whitening import bidiagonal, deviations, fit_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, n int, X string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 0, "clash") for k, v in enumerate(vectors)], SCHEMA)


def plain(vectors, wanted=16):
    good = {k: [math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for k, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, good.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array(sums) / n
    e, q = np.linalg.eigh(x.T @ x / n)
    return good, n, sums, e[::-1][:wanted], q[:, ::-1][:, :wanted], (x * x).sum() / n


def test_like_plain(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(c) for c in row] for row in rng.standard_normal((300, 20)) * np.linspace(1, 3, 20)]
    vectors += [vectors[5]] * 40 + [None, [], [float("nan")] + vectors[0][1:], [None] + vectors[0][1:], [float("inf")] + vectors[0][1:], vectors[0][:3]]
    out = whiten(frame(spark, vectors)).collect()
    good, n, sums, e, q, trace = plain(vectors[:-1])
    assert len(out) == 16 * len(good)
    got = {(r.vec_id, r.component): r for r in out}
    sign = [1 if got[0, k + 1].whitened * ((np.array(good[0]) - np.array(sums) / n) @ q[:, k]) > 0 else -1 for k in range(16)]
    for (i, k), r in got.items():
        want = sign[k - 1] * (np.array(good[i]) - np.array(sums) / n) @ q[:, k - 1] / math.sqrt(e[k - 1])
        assert r.n == n == 300 and r.deviation == sum((n * c - s) ** 2 for c, s in zip(good[i], sums))
        assert abs(r.whitened - want) < 1e-8 and abs(r.explained - e[k - 1] / trace) < 1e-12 and r.identity_error < 1e-9


def test_few_and_flat(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    two = whiten(frame(spark, [[1.0, 2.0], [2.0, 2.0], [2.0, 2.0]])).collect()
    assert sorted((r.vec_id, r.component, round(r.whitened, 9) ** 2, r.n, r.explained) for r in two) == [(k, 1, 1.0, 2, 1.0) for k in range(3)]
    square = [[float(a), float(b), float(c)] for a in (0, 1) for b in (0, 1) for c in (0, 1)]  # one eigenvalue, three times
    out = whiten(frame(spark, square)).collect()
    assert len(out) == 24 and all(abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-9 for r in out)


def test_far_entries(spark):
    far = frame(spark, [[1e30, 0.0], [1e9, 1.0], [2e9, 5.0], [0.5, 7.0]])
    assert {r.vec_id for r in whiten(far).collect()} == {1, 2, 3}
    x = np.array([[1 << 40, 0], [3, 4]])
    assert deviations(x, 1 << 20, [5, 7]) == [None, (3 * (1 << 20) - 5) ** 2 + (4 * (1 << 20) - 7) ** 2]


@pytest.mark.parametrize("tolerance", [0.0, 1e-13])
def test_bidiagonal(tolerance):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 60)) @ np.diag(np.geomspace(1, 1e-6, 60))
    calls = []

    def product(y, g):
        calls.append(1)
        u = x @ y
        return x.T @ u, (x @ g).T @ u, float(u @ u)

    values, vectors = bidiagonal(product, 60, 8, tolerance)
    _, want, rows = np.linalg.svd(x)
    assert np.allclose(values, want[:8], rtol=1e-11) and np.allclose(np.abs((rows[:8] * vectors.T).sum(axis=1)), 1, atol=1e-12)
    assert len(calls) < 40 if tolerance else len(calls) >= 60


def test_same_whatever_the_partitions(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, [[float(c) for c in row] for row in rng.standard_normal((100, 8))])
    a, b = fit_whitening(df), fit_whitening(df.repartition(7))
    assert a.sums == b.sums and np.allclose(a.values, b.values, rtol=1e-12)
