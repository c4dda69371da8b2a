"""Periodic runs against all periods at all places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from postglean.llm import periodic_runs as p


def _plain(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                s = i
                while i + q < n and w[i] == w[i + q]:
                    i += 1
                out.setdefault((s, i + q), q)
            else:
                i += 1
    return sorted([(s, e - s, q) for (s, e), q in out.items() if e - s >= max(6, 4 * q)], key=lambda r: (r[0], r[2]))


def _words(rng):
    n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a, q = rng.randrange(n), rng.randint(1, 7)
        w = (w[:a] + (w[a : a + q] * n))[:n]
    return w


@pytest.mark.parametrize("kept", [16, 1 << 15])
def test_against_plain(monkeypatch, kept):
    monkeypatch.setattr(p, "KEPT", kept)
    monkeypatch.setattr(p, "PAIRS", 64 if kept == 16 else 1 << 20)
    monkeypatch.setattr(p._Grid, "n", 0)
    rng = random.Random(kept)
    for _ in range(1500):
        w = _words(rng)
        assert p.runs(np.array(w, np.int64)) == _plain(w)


def test_agreement_and_minima():
    rng = np.random.default_rng(2)
    w = np.concatenate([rng.integers(0, 2, 300), np.tile(rng.integers(0, 3, 5), 40)])
    order, rank = p.suffix_array(w)
    assert order.tolist() == sorted(range(len(w)), key=lambda i: w[i:].tolist()) and (order[rank] == np.arange(len(w))).all()
    a, b = rng.integers(0, len(w), 500), rng.integers(0, len(w), 500)
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    want = [next((k for k in range(len(w) - y) if w[x + k] != w[y + k]), len(w) - y) for x, y in zip(a, b)]
    assert p.Agreement(w).of(a, b).tolist() == want
    values = rng.integers(0, 99, 2000).astype(np.int32)
    a, b = rng.integers(0, 2000, 900), rng.integers(0, 2000, 900)
    a, b = np.minimum(a, b), np.maximum(a, b)
    assert p._Minima(values).least(a, b).tolist() == [values[x : y + 1].min() for x, y in zip(a, b)]


def _row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            q = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]
    runs = _plain(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
    figures = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", *[" ".join(map(str, _words(rng))) for _ in range(250)], "na na \x0bna\x0cna na na na é", "so " * 3000, "a b c " * 900 + "d"]
    rows = [(k if k else None, t, "x", 0) for k, t in enumerate(texts)] + [(7, texts[7], "x", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, best int").repartition(3)
    got = p.digests(p.periodic_runs(df, edit=p.looped))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(_row(*r[:2])) for r in rows)
    assert p.digests(p.periodic_runs(df.limit(0))).count() == 0


def test_a_very_long_text():
    w = np.concatenate([np.arange(40_000), np.tile(np.arange(12_000), 5), np.zeros(9, int) - 1])
    assert p.runs(w) == [(40_000, 60_000, 12_000), (100_000, 9, 1)]
