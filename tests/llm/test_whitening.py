"""Whitening against exact fractions and the contract's figures."""

from fractions import Fraction

import numpy as np
import pytest

from postglean.llm import whitening as w


def _exact(x):
    n, total = len(x), [int(t) for t in x.sum(axis=0)]
    return [[sum(Fraction(int(a) * int(b)) for a, b in zip(x[:, i], x[:, j])) - Fraction(total[i] * total[j], n) for j in range(x.shape[1])] for i in range(x.shape[1])]


def test_the_sum_is_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 5)) * [1, 50, 3000, 10, 1e6]).astype(np.int64) + w.SHIFT
    total = [int(t) for t in x.sum(axis=0)]
    halves = [w.product(c, c) for c in (w.centred(part, total, len(x)) for part in (x[:100], x[100:]))]
    high, low = w.add(*halves)
    for i, row in enumerate(_exact(x)):
        for j, want in enumerate(row):
            room = abs(_exact(x)[i][i] * _exact(x)[j][j])
            assert (Fraction(high[i, j]) + Fraction(low[i, j]) - want) ** 2 <= room * Fraction(1, 2**196)


def test_small_eigenvalues_keep_their_digits():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 8)) * 3000).astype(np.int64) + w.SHIFT
    x[:, 5] = x[:, 4]
    x[0, 5] += 1  # a variance of 1e-10 of the greatest
    x[:, 7] = x[:, 6]  # none
    c = w.centred(x, [int(t) for t in x.sum(axis=0)], len(x))
    high, low = w.product(c, c)
    value, vectors = w.eigen(high, low)
    assert value[6] / value[0] < 1e-9 and value[7] < w.NO_VARIANCE * value[0]
    projected = (c[0] @ vectors[:, :7]) / np.sqrt(value[:7])
    assert np.abs(projected.T @ projected - np.eye(7)).max() < 1e-8
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-15


def _rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, dim string").repartition(3)


def test_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(200, 40)) / 8]
    rows = [(k, v, "clash", "y") for k, v in enumerate(good)] + [(None, good[0], "", ""), (5, good[5], "", "")]
    bad = [(900, None, "", ""), (901, [None] * 40, "", ""), (902, [float("nan")] * 40, "", ""), (903, [float("inf")] + [0.0] * 39, "", ""), (904, [], "", ""), (905, [1.0, 2.0], "", "")]
    got = w.whiten(_rows(spark, rows + bad)).collect()
    x = np.array([np.floor(64 * np.array(v)) for _, v, *_ in rows]).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    covariance = np.array([[float(e / n) for e in row] for row in _exact(x)])
    value, vectors = np.linalg.eigh(covariance)
    value, vectors = value[::-1], vectors[:, ::-1]
    want = (x - total / n) @ vectors[:, :32] / np.sqrt(value[:32])
    assert len(got) == 32 * n and {r.vec_id for r in got} == {r[0] for r in rows}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    first = {}
    for r in got:
        first.setdefault((r.vec_id, r.component), r)
    for k, (vec_id, *_) in enumerate(rows):
        for c in range(32):
            r = first[vec_id, c + 1]
            assert r.deviation == sum((n * int(a) - int(t)) ** 2 for a, t in zip(x[k], total))
            assert abs(abs(r.whitened) - abs(want[k, c])) < 1e-8 and r.explained == pytest.approx(value[c] / value.sum(), rel=1e-9)
    signs = {c: {np.sign(first[vec_id, c + 1].whitened * want[k, c]) for k, (vec_id, *_) in enumerate(rows) if abs(want[k, c]) > 1e-3} for c in range(32)}
    assert all(len(s) == 1 for s in signs.values())


def test_lists_without_variance(spark):
    assert w.whiten(_rows(spark, [])).count() == 0
    assert w.whiten(_rows(spark, [(1, [1.0, 2.0], "", "")] * 3 + [(2, [1.0], "", "")])).count() == 0
    one = w.whiten(_rows(spark, [(1, [1.0, 2.0], "", ""), (2, [3.0, 2.0], "", ""), (3, [1.0, 2.0, 3.0], "", "")])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 12), r.explained) for r in one) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_long_vectors_and_exact_deviations(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(c) for c in v], "", "") for k, v in enumerate(rng.integers(-(2**40), 2**40, (6, 300)))]
    got = w.whiten(_rows(spark, rows), components=500).collect()
    x = np.array([[int(64 * np.float32(c)) + 1_000_000 for c in r[1]] for r in rows], object)
    total = x.sum(axis=0)
    assert {r.component for r in got} == set(range(1, 6)) and got[0].identity_error < 1e-10
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(k, sum((6 * a - t) ** 2 for a, t in zip(x[k], total))) for k in range(6)}
