"""Components against all pairs."""

import random
import re

import pytest

from postglean.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, row string, n long"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=3, share=90):
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("frequent, width, share", [(False, 3, 90), (True, 3, 90), (True, 5, 80)])
def test_components(spark, monkeypatch, frequent, width, share):
    if frequent:
        monkeypatch.setattr(J, "FEW", 3)
        monkeypatch.setattr(J, "BLOCK", 4)
    random.seed(5)
    words = [f"w{k}" for k in range(3000)]
    bases = [[random.choice(words) for _ in range(random.choice([1, 2, 3, 9, 12, 30, 62, 66, 70, 75, 200, 400, 900, 1100, 1300, 4000]))] for _ in range(60)]
    common = random.choices(words, k=60)
    texts = []
    for b in bases:
        for _ in range(random.choice([1, 2, 12])):
            t = list(b)
            for _ in range(random.randrange(0, 1 + len(t) // 40)):
                t[random.randrange(len(t))] = random.choice(words)
            texts.append(" ".join(t if random.random() < 0.7 else t + common))
        if random.random() < 0.4:
            texts.append(" ".join(b[: int(len(b) * random.choice([0.79, 0.8, 0.81, 0.89, 0.9, 0.91]))]))
    rows = [(k * 7 % 1009, t, "x", k) for k, t in enumerate(texts)]
    rows += [(2000, None, None, 1), (2001, "", "", 2), (None, texts[0].upper(), "", 3), (None, "alone here now", "", 4), (2002, "\t\n ", "", 5), (2003, "long " * 20000, "", 6), (2003, "long " * 20000, "", 6), (2004, "É a b", "", 7), (2005, "é a b", "", 7)]
    random.shuffle(rows)
    got = J.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=width, least=share).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute(rows, width, share)))
    firsts = [r for r in got if r.first]
    assert len({r.component_id for r in got if r.component_id is not None}) == len([r for r in firsts if r.component_id is not None])


def test_entries_meet():
    """Any two similar sets share an entry, whatever is frequent."""
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(3000):
        n = int(rng.integers(1, 150))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = rng.random(len(a)) > rng.choice([0.02, 0.05, 0.1])
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 20))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 90 * (len(a) + len(b) - same):
            both = rng.permutation(np.union1d(a, b))
            rare = int(len(both) * rng.choice([0, 0.05, 0.5, 1]))
            place = {x: k for k, x in enumerate(both.tolist())}
            found = [J.entries(np.array(sorted(x.tolist(), key=place.get), np.uint64), sum(place[v] < rare for v in x.tolist()))[0] for x in (a, b)]
            assert len(np.intersect1d(*found))


def test_long_sets_meet():
    """Similar long sets share a combination, whatever their sizes; sets that share a passage hardly ever do."""
    import numpy as np

    rng = np.random.default_rng(7)
    met = 0
    for least in (80, 90):
        for _ in range(150):
            n = int(rng.integers(900, 9000))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone = int(len(a) * rng.uniform(0, (100 - least) / 100))
            new = int(len(a) * rng.uniform(0, (100 - least) / 100))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            alike = 100 * same >= least * (len(a) + len(b) - same)
            assert J.similar(a, b, least) == alike
            found = [J.entries(rng.permutation(x), 0, least) for x in (a, b)]
            assert all(f[1] for f in found)
            if alike and min(len(a), len(b)) >= J.LONG:
                assert len(np.intersect1d(found[0][0], found[1][0])), (least, len(a), len(b), same)
            c = np.unique(np.concatenate([a[:46], rng.integers(0, 2**63, n).astype(np.uint64)]))
            met += len(a) >= 2000 and bool(len(np.intersect1d(J.combined(a, least, 2)[0], J.combined(c, least, 2)[0])))
    assert met < 15


def test_nothing(spark):
    assert J.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
