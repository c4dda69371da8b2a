"""Targets against step-by-step resharing; rounding against its contract."""

import random
import re

from postglean.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, source string, n long, size string"


def reshared(size, weights=(5, 2, 1)):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, left = {}, 1.5 * sum(size.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: (left - sum(full.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            return {**full, **share}
        full |= {s: 2.0 * size[s] for s in over}


def test_mix(spark):
    random.seed(3)
    rows = [(k, "w " * random.randrange(0, 90), random.choice(["a", "b", "b", "b", "b", "c", "é", None]), k, "x") for k in range(1500)]
    rows += [(None, None, "b", 1, None), (5, "\t\n", "tiny", 2, None), (5, "one\x0btwo\x1cthree", "tiny", 2, None), (9, "twin text", "a", 0, ""), (9, "twin text", "a", 0, "")]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), str(r[2])) for r in rows)
    size, taken, target, widest = {}, {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        widest[r.source] = max(widest.get(r.source, 0), r.size)
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    for s, want in reshared(size).items():
        assert abs(target[s] - want) < 1e-6 * max(1, want)
        assert abs(taken[s] - want) <= widest[s] / 2 + 1e-6
    again = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_nothing(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[-1] for r in mix_sources(spark.createDataFrame([(1, "", None, 0, None)], SCHEMA)).collect()] == [0]
