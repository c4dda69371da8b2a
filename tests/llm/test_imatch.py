"""Fingerprints: the edit, the order and the likeness of copies."""

import random
from hashlib import sha256

from postglean.llm import imatch

SCHEMA = "doc_id long, text string, n_chars string"


def test_fingerprints(spark):
    random.seed(4)
    words = ["w" + "".join(random.choices("abcdef", k=5)) for _ in range(6000)]
    texts = [" ".join(random.choices(words, k=random.randrange(40, 400))) for _ in range(300)]
    rows = [(3 * k, t, None) for k, t in enumerate(texts)]
    near = texts[0].split()
    near[5] = "changed"
    rows += [(None, None, "x"), (-1, texts[0], ""), (-2, " ".join(near), ""), (2001, "", ""), (2002, "ünï 🙂 ..", ""), (2003, "x" * 5000, ""), (2003, "x" * 5000, ""), (2004, "!? .", "")]
    got = imatch.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r.doc_id: r for r in got}
    sign = {}
    for k, (doc_id, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = by[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest()) or doc_id == 2003
        assert sign.setdefault(text, r.fingerprint) == r.fingerprint
        assert sign.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint or doc_id == 2003
    assert by[-2].near_next > 0.6 and by[-2].fingerprint != by[-1].fingerprint
    whole = [r for r in got if r.n_chars > 200]
    mean = lambda c: sum(r[c] for r in whole) / len(whole)
    assert mean("near_next") < 0.1 and mean("near_edited") > 3 * mean("near_next") and mean("near_edited") > 0.1
    assert sum(r.near_edited == 0 for r in whole) < 0.05 * len(whole)


def test_against_plain_sets(spark):
    """Every fingerprint and likeness again, from a lexicon and subsets worked out over plain sets."""
    import numpy as np
    import xxhash

    random.seed(14)
    words = ["".join(random.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = [(k, " ".join(random.choices(words[: 20 + k], k=random.randrange(0, 60))), None) for k in range(200)]
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = {t: sum(t in set(r[1].split()) for r in rows) for t in set(" ".join(r[1] for r in rows).split())}
    band = {t for t, n in held.items() if n >= len(rows) / 2000 and n - 1 <= (len(rows) - 1) / 4}

    def chosen(term, j):
        x = (xxhash.xxh3_64_intdigest(term.encode()) + (j + 1) * 0x9E3779B97F4A7C15) % 2**64
        for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * m % 2**64
        return (x ^ (x >> 31)) / 2**64 < 0.5 ** next(k + 2 for k in range(8) if j < sum((4, 4, 4, 8, 16, 20, 20, 20)[: k + 1]))

    def signed(text):
        own = sorted(set(text.split()))
        out = [f"{xxhash.xxh3_64_intdigest(' '.join(own).encode()) >> 32:08x}"]
        for j in range(96):
            keys = [xxhash.xxh3_64_intdigest(t.encode()) for t in own if t in band and chosen(t, j)]
            out.append(f"{xxhash.xxh3_64_intdigest(np.array(keys, np.uint64).tobytes()) >> 32:08x}" if keys else "-" * 8)
        return out

    def near(a, b):
        either = [(x, y) for x, y in zip(a, b) if (x, y) != ("-" * 8, "-" * 8)]
        return sum(x == y for x, y in either) / len(either)

    for k, (doc_id, text, _) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        own, edited, following = signed(text), signed(text[: len(text) - half] + after[:half]), signed(after)
        r = got[doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(own), "".join(edited))
        assert abs(r.near_edited - near(own, edited)) < 1e-12 and abs(r.near_next - near(own, following)) < 1e-12


def test_few(spark):
    assert imatch.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    only = imatch.fingerprints(spark.createDataFrame([(1, "abcd", None)], SCHEMA)).collect()
    assert len(only) == 1 and only[0].edited_sha256 == sha256(b"abab").hexdigest() and only[0].near_next == 1.0
