"""Token files and packing against the library itself and plain Python."""

import functools
import random
import zlib

import numpy as np
import pytest

from postglean.llm import packing, token_files, tokens

SCHEMA = "doc_id long, text string, n long, start string"
ROWS = [
    (3, "one two, three.\nfour", 1, "x"), (1, "", 2, None), (2, None, 3, "y"), (None, "no id at all", 4, "z"), (7, "same", 5, ""), (7, "same", 6, ""),
    (5, "word " * 3000, 7, "long"), (6, "a  b\t\tc '' don't ünï 🙂 ..?!\n\n x ", 8, None), (-4, "<|endoftext|>", 9, "q"),
]


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return t


def reference_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_library():
    random.seed(2)
    alphabet = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'", ".", ",", "!?", "9", "ä", "²", "一", "\t", " ", "don't", "<|endoftext|>", "\x1c", "🙂", "_", "\r\n", "\0", "×"]
    e = tokens.Encoder.of(tokens.default_tokenizer())
    for _ in range(4000):
        text = "".join(random.choice(alphabet) for _ in range(random.randrange(14)))
        assert np.frombuffer(e.ids(text), "<u4").tolist() == reference_ids(text)[:-1], text


@pytest.mark.parametrize("values", [[], [0], [1] * 200, [2**63 - 1, 0, 5], [2**60 - 1], list(range(3000)), [7, 90000, 3] * 50, [4095] * 9, [50256] * 7 + [1] * 13])
def test_simple8b_round_trip(values):
    words, escapes = token_files.encode(np.array(values, np.uint64))
    assert token_files.decode(words, escapes, len(values)).tolist() == values


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)
    got = [tuple(r) for r in token_files.token_files(spark.createDataFrame(ROWS, SCHEMA)).orderBy("start").collect()]
    want, start = [], 0
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(reference_ids(text), "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_files(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_fills_bins():
    random.seed(1)
    counts = {n: random.randrange(1, 9) for n in random.sample(range(1, 64), 40)}
    rows = packing.plan(counts, 64)
    bins = {}
    for length, _, times, sequence, offset in rows:
        for k in range(times):
            bins.setdefault(sequence + k, []).append((offset, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(k * n for k, n in counts.items()) / 64


def test_pack(spark):
    got = packing.pack(spark.createDataFrame(ROWS, SCHEMA), capacity=128).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = np.array(reference_ids(text), "<u4")
        cuts = [0, *range(len(ids) % 128 or 128, len(ids) + 1, 128)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(r.length for r in got) // 128) + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
