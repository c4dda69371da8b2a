"""Secret scans against regular expressions and the contract's digests."""

import hashlib
import random
import re

import numpy as np

from postglean.llm.secret_scan import BASE, RULES, Automaton, Rule, Scanner, _Pattern, digests, secrets

PLAIN = {
    "assign": (re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m.group(1)) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
}
PARTS = ["password", "Token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc123", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGH01234567", "\n", "x", "token=", "passwd", "é", "ſ", "-", "_", "."]


def _spans(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in PLAIN[kind][0].finditer(text) if PLAIN[kind][1](m)]
    return sorted(found)


def _digest(text):
    return hashlib.sha256(",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in _spans(text)).encode()).hexdigest()


def _texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_against_regular_expressions():
    texts = [*_texts(1500), "a" * 70_000 + " token=secret9 ", "secret = " * 4000, "f" * 30_000, "", "secret=token: abcdefgh"]
    data = [t.encode() for t in texts]
    found = Scanner.of(RULES).scan(b"".join(data), np.cumsum([len(d) for d in data]))
    for k, (text, own) in enumerate(zip(texts, data)):
        got = [(len(own[:a].decode()), kind, len(own[:b].decode())) for a, kind, b in found.get(k, []) if kind < len(BASE)]
        assert got == _spans(text)


def test_the_automaton_is_the_least():
    """Of two equal rules, and of a rule and itself written otherwise, no state is left over."""
    one = Automaton.of([_Pattern("ab+c?").tree], False)
    other = Automaton.of([_Pattern("a(b)(b|b)*(c|)").tree], False)
    assert one.step.shape[0] == other.step.shape[0] == 5
    for text in ("", "a", "ab", "abbc", "abcc", "abcb"):
        s = one.first
        for b in text.encode():
            s = one.step[s, one.class_of[b]]
        assert bool(one.accepts[s]) == bool(re.fullmatch("ab+c?", text))


def test_more_rules():
    texts = ["x ghp_" + "a1B2" * 9 + " y", "ghp_short", "-----BEGIN RSA PRIVATE KEY-----", "see https://me:pa%20ss@host/", "https://host:80/a@b"]
    data = [t.encode() for t in texts]
    found = Scanner.of(RULES).scan(b"".join(data), np.cumsum([len(d) for d in data]))
    assert {k: [RULES[r].kind for _, r, _ in v] for k, v in found.items()} == {0: ["github"], 2: ["pem"], 3: ["address"]}
    assert Scanner.of((Rule("ab", "a{2,3}b?"),)).scan(b"xaaaabaab", np.array([9])) == {0: [(1, 0, 4), (6, 0, 9)]}


def test_rows(spark):
    texts = [None, "", *_texts(300), "é" * 40_000 + "password: hunter22", "token=abcdef", "token=abcdef"]
    rows = [(k if k else None, t, "clash", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, bytes int").repartition(3)
    got = sorted(digests(secrets(df)).collect(), key=lambda r: r.doc_id or 0)
    assert len(got) == len(rows) and got[0].doc_id is None
    for r, (_, text, *_) in zip(got, rows):
        own = _spans(text or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in own) for j in range(3))
        assert r.base_sha256 == _digest(text or "")
        base = [s for s in r.spans.split(",") if s.split(":")[0] in PLAIN]
        assert base == [f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in own]
    assert digests(secrets(df.limit(0))).count() == 0
