"""Top-k against brute force."""

import numpy as np
import pytest

from postglean.llm import vector_search as V

SCHEMA = "vec_id long, embedding array<float>, label int, query_id string"


def brute(rows, k=5):
    ok = [(i, r[0], np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(np.int64)) for i, r in enumerate(rows) if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all()]
    out = []
    for i, q, x in ok:
        if q is not None and q % 50 == 0:
            best = sorted((-int(x @ y), v is None, v or 0, j) for j, v, y in ok if j != i and len(y) == len(x))[:k]
            out += [(q, n + 1, None if null else v, -s) for n, (s, null, v, _) in enumerate(best)]
    return sorted(map(str, out))


@pytest.mark.parametrize("scale", [1, 1e6])
def test_top_k(spark, scale, monkeypatch):
    monkeypatch.setattr(V, "COMPONENTS", 800)
    monkeypatch.setattr(V, "BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=8) * scale).tolist(), 1, "x") for k in range(400)]
    rows += [(1000 + k, rows[50][1], 1, None) for k in range(150)] + [(50, rows[3][1], 0, ""), (None, rows[50][1], 0, ""), (None, [0.5] * 8, 1, "")]
    rows += [(2000, None, 1, ""), (2050, [1.0] * 7 + [None], 1, ""), (2100, [float("nan")] * 8, 1, ""), (2150, [], 1, ""), (2151, [], 1, ""), (2200, [0.1, 0.2], 1, ""), (2201, [0.3, 0.2], 1, "")]
    rows += [(2250, [float("-inf")] * 8, 1, ""), (2300, [0.25] * 5000, 1, ""), (2301, [0.5] * 5000, 1, "")]
    got = V.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_few_exact_vectors_are_read(spark):
    """Cells leave little open: a few in a hundred, and one very common vector adds no more than k + 1 to each query."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64)) / 8
    rows = [(k, v.tolist(), 1, None) for k, v in enumerate(x)] + [(10_000 + k, x[7].tolist(), 1, None) for k in range(2000)]
    chunks = V.approximated(spark.createDataFrame(rows, SCHEMA))
    asked = sum(r[0] % 50 == 0 for r in rows)
    read = V.candidates(chunks).count()
    assert asked * V.K <= read < asked * 4000 * 0.05


def test_bounds():
    rng = np.random.default_rng(4)
    for most in (200, 2**28):
        vectors, queries = (rng.integers(-most, most, (n, 16)) for n in (300, 20))
        lower, upper = V.Approximation.of(vectors).bounds(queries)
        exact = queries @ vectors.T
        assert (lower <= exact).all() and (exact <= upper).all()


def test_nothing(spark):
    assert V.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
