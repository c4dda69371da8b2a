"""Removed bytes against a table of all windows."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from postglean.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, n_bytes string"


def brute(rows):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((r[0], len(t), int(gone.sum()), runs, sha256(kept).hexdigest()))
    return sorted(map(str, out))


def cases():
    random.seed(7)
    word = lambda: "".join(random.choices("abcdeé", k=random.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(random.randrange(20, 160)) for _ in range(40)]
    shared = [text(n) for n in (35, 45, 60, 120)]
    texts = list(base)
    for t in base[:20]:
        w = t.split()
        for _ in range(random.randrange(1, 4)):
            w[random.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [b + " " + random.choice(shared) + " " + text(20) for b in base[20:]]
    texts += [base[0], base[0], "", None, "x" * 1000, "x" * 900 + "y" * 300, "ab" * 300, "a" * 199, "b" * 200, "c" * 201, shared[3][:200], shared[3][1:201] + "!", "\0" * 500, "q" + "\0" * 260]
    return [(k, t, None) for k, t in enumerate(texts)] + [(None, base[1], ""), (5, base[2], "")]


@pytest.mark.parametrize("hot", [False, True])
def test_remove(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(S, "HOT", 1)
        monkeypatch.setattr(S, "_RUN", 3000)
    rows = cases()
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == brute(rows)
    assert all(sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if r.n_removed == 0)


def test_hot_anchor_is_split(spark, monkeypatch):
    """No suffix array takes more than HOT snippets of an anchor, though one line has many contexts."""
    monkeypatch.setattr(S, "HOT", 20)
    inner = S._sorted

    def bounded(batches):
        for batch in batches:
            groups = Counter(zip(*(batch[c].to_pylist() for c in batch.schema.names if c in ("part", "anchor"))))
            assert max(groups.values(), default=0) <= 20, "a hot anchor in one array"
            yield from inner(iter([batch]))

    monkeypatch.setattr(S, "_sorted", bounded)
    random.seed(11)
    noise = lambda n: "".join(random.choices("abcdefgh ", k=n))
    line = noise(230)
    rows = [(k, noise(150) + line + noise(150), None) for k in range(90)] + [(90 + k, noise(300), None) for k in range(5)]
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == brute(rows)


def test_order():
    """Suffixes of each piece in order of their first bytes; pieces' ends first."""
    random.seed(8)
    for _ in range(300):
        pieces = [bytes(random.choices(b"abc", k=random.randrange(8, 40))) for _ in range(6)]
        counts = [len(p) - 7 for p in pieces]
        text, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])
        order = S.two_stage_order(text, ends, np.array(counts), 8)
        windows = [bytes(text[k : k + 8]) for k in order]
        assert len(order) == sum(counts) and windows == sorted(windows)


def test_nothing(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_hashed_in_runs(spark):
    """Passages on the borders of runs, and one text longer than a run that repeats itself."""
    random.seed(13)
    noise = lambda n: "".join(random.choices("abcdefghijklmnop ", k=n))
    passage = noise(300)
    run = S._RUN
    long = noise(run - 150) + passage + noise(run // 2)
    rows = [(1, long, None), (2, noise(500) + passage + noise(500), None), (3, "z" * (run + 500), None), (4, noise(2 * run + 77), None)]
    got = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (300, 1) and got[1].kept_sha256 == sha256((long[: run - 150] + long[run + 150 :]).encode()).hexdigest()
    assert (got[2].n_removed, got[2].n_spans) == (300, 1)
    assert (got[3].n_removed, got[3].n_spans) == (run + 500, 1) and got[4].n_removed == 0


def test_equal_places_are_one_row():
    """A line that all texts of a run hold is joined as few rows, whatever their number; all its places are told."""
    random.seed(17)
    noise = lambda n: "".join(random.choices("abcdefgh ", k=n))
    line = noise(700)
    texts = [noise(150) + line + noise(150) for _ in range(40)]
    out = pa.Table.from_batches(S._found(iter([pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([t.encode() for t in texts])], ["row", "bytes"])]))).to_pylist()
    assert len({(r["anchor"], r["digest"]) for r in out}) == len(out)
    places = sorted((p["row"], p["at"], r["anchor"]) for r in out for p in [r, *(r["more"] or [])])
    assert any(len(r["more"] or []) == 39 for r in out)
    for k, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        first, _, _, anchor, _ = S.snippets(data, np.array([len(data)]))
        assert sorted(zip(first.tolist(), anchor.tolist())) == [(at, a) for row, at, a in places if row == k]


def test_windows_of_a_hot_anchor_are_counted_in_blocks(spark, monkeypatch):
    """Where all texts hold one line, only windows at its borders are counted one by one."""
    monkeypatch.setattr(S, "HOT", 20)
    made, inner = {}, S.written
    monkeypatch.setattr(S, "written", lambda df, name: made.setdefault(name, inner(df, name)))
    random.seed(19)
    noise = lambda n: "".join(random.choices("abcdefgh ", k=n))
    line = noise(260)
    rows = [(k, noise(150) + line + noise(150), None) for k in range(90)]
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == brute(rows)
    blocks = made["cut"].where("core is not null")
    assert 0 < made["windows"].count() <= 2 * S.BLOCK * 90 < blocks.selectExpr("sum(n)").first()[0] / 3 and blocks.count() < blocks.selectExpr("sum(n)").first()[0] / 5
