"""The trie against dictionaries: base exactly, the model but for quantisation."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from postglean.llm import lm_trie as L

SCHEMA = "doc_id long, text string, score string"


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 5), (64, 64), (65, 10**6), (1000, 10**12), (300, 10)):
        values = np.sort(rng.integers(0, most + 1, n))
        unique = np.unique(values)
        assert L.EliasFano.of(values).at(np.arange(n)).tolist() == values.tolist() if n else True
        e = L.EliasFano.of(unique)
        asked = np.concatenate([unique, rng.integers(0, most + 2, 200)])
        place = {v: k for k, v in enumerate(unique.tolist())}
        assert e.find(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows):
    train = [tokens(t) for d, t, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
    c = [Counter(tuple(t[k : k + n]) for t in train for k in range(len(t) - n + 1)) for n in (1, 2, 3)]
    total, distinct = sum(c[0].values()), len(c[0])
    p1 = lambda w: (c[0][(w,)] + 0.1) / (total + 0.1 * (distinct + 1))

    def p(context, w):
        n = len(context)
        return (c[n][(*context, w)] + L.MU * p(context[1:], w)) / (c[n - 1][context] + L.MU) if n else p1(w)

    out = {}
    for d, text, _ in rows:
        t = tokens(text)
        out[d] = (len(t), sum((w,) in c[0] for w in t), total, sum(math.log10(p1(w)) for w in t), sum(math.log10(p(tuple(t[max(0, k - 2) : k]), w)) for k, w in enumerate(t)))
    return out


@pytest.mark.parametrize("shard, run, frequent", [(4_000_000, 4_000_000, 65_535), (300, 1000, 65_535), (300, 1000, 9)])
def test_scores(spark, monkeypatch, shard, run, frequent):
    for name, value in (("SHARD", shard), ("RUN", run), ("FREQUENT", frequent)):
        monkeypatch.setattr(L, name, value)
    random.seed(9)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(random.choices(words[:20], k=30) + random.choices(words, k=10)), None) for k in range(150)]
    rows += [(k, rows[k - 200][1].upper(), "") for k in range(200, 230)] + [(500, None, ""), (501, "", ""), (None, "w1 new", ""), (502, "x" * 3000 + " é", "")]
    got = L.score(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and abs(r.score - score) < 2e-3 * n
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)


def test_nothing(spark):
    assert L.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_kept(spark, monkeypatch):
    """N-grams count however small their share of the training tokens, in many shards and batches."""
    monkeypatch.setattr(L, "SHARD", 500, raising=False)
    monkeypatch.setattr(L, "RUN", 2000, raising=False)
    random.seed(10)
    words = [f"w{k}" for k in range(400)]
    rows = [(500, "a " * 1_200_000, ""), (501, None, "")] + [(k, " ".join(random.choices(words, k=40)), None) for k in range(200)]
    rows += [(k, rows[k - 198][1], "") for k in range(200, 230)]
    got = L.score(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows) and got[0].train_tokens > 1 << 20
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and abs(r.score - score) < 2e-3 * n


def _grams(rng, n):
    words = np.unique(rng.integers(-(2**60), 2**60, 60))
    first, second = rng.choice(words, n), rng.choice(words, n)
    of = rng.integers(0, n, 2 * n)
    return words, first, second, rng.integers(0, 4, n), of, rng.choice(words, 2 * n), rng.integers(0, 3, 2 * n)


def test_trie_against_dictionaries(tmp_path):
    """Built from repeated n-grams, saved, mapped from its file, asked for what it has and hasn't."""
    rng = np.random.default_rng(5)
    words, first, second, n2, of, third, n3 = _grams(rng, 3000)
    path = tmp_path / "trie"
    path.write_bytes(L.Trie.of(first, second, n2, of, third, n3).save())
    trie = L.Trie.load(np.memmap(path, np.uint8, "r"))
    two, three = Counter(), Counter()
    for a, b, n in zip(first.tolist(), second.tolist(), n2.tolist()):
        two[a, b] += n
    for k, c, n in zip(of.tolist(), third.tolist(), n3.tolist()):
        three[int(first[k]), int(second[k]), c] += n
    asked = [(a, b) for a in [*words[:20].tolist(), 7] for b in [*words[::3].tolist(), -9]]
    deep = [(a, b, c) for a, b in asked for c in [*words[::9].tolist(), 3]]
    seconds, thirds = np.full(21, len(asked) // 21), np.full(len(asked), len(deep) // len(asked))
    count, weight, direct = trie.answer(np.array([*words[:20], 7]), seconds, np.array([b for _, b in asked]), thirds, np.array([c for *_, c in deep]))
    for k, g in enumerate(asked):
        assert (count[k] == L.NONE) == (two[g] == 0)
        if two[g]:
            assert abs(L._unquantised(float(count[k])) - math.log10(two[g])) <= L.STEP and abs(L._unquantised(float(weight[k])) - math.log10(L.MU / (two[g] + L.MU))) <= L.STEP
    for k, g in enumerate(deep):
        assert (direct[k] == L.NONE) == (three[g] == 0 or two[g[:2]] == 0)
        if direct[k] != L.NONE:
            assert abs(L._unquantised(float(direct[k])) - math.log10(three[g] / (two[g[:2]] + L.MU))) <= L.STEP


def test_pointers_rise():
    rng = np.random.default_rng(6)
    _, first, second, n2, of, third, n3 = _grams(rng, 500)
    trie = L.Trie.load(L.Trie.of(first, second, n2, of, third, n3).save())
    for level in (trie.two, trie.three):
        starts = level.starts.at(np.arange(level.starts.n))
        keys = level.sequence.at(np.arange(level.sequence.n))
        assert (np.diff(starts) >= 0).all() and (np.diff(keys) > 0).all() and starts[-1] == level.sequence.n
        assert (np.bincount(keys >> level.width, minlength=level.starts.n - 1) == np.diff(starts)).all()


def test_stored_tries_hold_all(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 200)
    rows = [(k, f"a b w{k % 7} c a b", None) for k in range(100)]
    shards = [L.Trie.load(r.trie) for r in L.trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    train = [tokens(t) for d, t, _ in rows if zlib.crc32(str(d).encode()) % 10]
    assert len(shards) > 1 and sum(t.three.sequence.n for t in shards) == len({tuple(t[k : k + 3]) for t in train for k in range(len(t) - 2)})


def test_words_of_one_hash_get_another_seed(spark, monkeypatch):
    real = L._batched

    def batched(it, seed):
        for batch in real(it, seed):
            if seed == 0:  # all words are one
                words = np.frombuffer(batch["words"][0].as_py(), np.int64)
                batch = batch.set_column(batch.schema.get_field_index("words"), "words", L.pa.array([np.full(len(words), 10**6).tobytes()], L.pa.binary()))
            yield batch

    monkeypatch.setattr(L, "_batched", batched)
    rows = [(k, f"a b c w{k}", None) for k in range(30)]
    got = {r.doc_id: r for r in L.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert all(abs(got[d].base_score - x[3]) < 1e-9 * abs(x[3]) for d, x in want.items())
