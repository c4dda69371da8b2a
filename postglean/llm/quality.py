"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each text. Expectation
maximisation over the counts of all vote patterns estimates how often each
heuristic votes what on good and on bad texts, without any gold label, and so
each pattern's posterior. Posterior labels of a bounded sample train a logistic
scorer over hashed features, which then judges every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import slices, text_bytes

BAD, NONE, GOOD = 0, 1, 2
#: Different texts that the scorer is fitted on, at most; features; least score that keeps a text.
SAMPLE = 8000
DIMS = 1 << 15
KEEP = 0.5
_MOST = 300_000

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"%$&#*|@^~_=+<>{}[]\\/!?"
_ENDS = b".,;:"


def measures(text: bytes, words: list[bytes]) -> dict[str, float]:
    """What the heuristics look at, each a share."""
    n, size = max(1, len(words)), max(1, len(text))
    letters = len(text) - len(text.translate(None, _LETTERS))
    return {
        "words": len(words), "letters": (len(text) - len(text.translate(None, _LETTERS + _DIGITS))) / size,
        "upper": (len(text) - len(text.translate(None, _UPPER))) / max(1, letters),
        "symbols": (len(text) - len(text.translate(None, _SYMBOLS))) / size,
        "distinct": len(set(words)) / n, "again": sum(map(eq, words, words[1:])) / n,
        "ends": (len(text) - len(text.translate(None, _ENDS))) / n,
        "bars": words.count(b"|") / n, "length": letters / n,
    }


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: Each heuristic sees one side of a text and abstains between its two bounds.
LABELLERS = {
    "symbols": lambda m: _vote(m["symbols"] > 0.05, m["symbols"] < 0.01),
    "letters": lambda m: _vote(m["words"] >= 10 and m["letters"] < 0.72, m["words"] >= 10 and m["letters"] > 0.78),
    "upper": lambda m: _vote(m["words"] >= 5 and m["upper"] > 0.4, m["words"] >= 5 and m["upper"] < 0.15),
    "repeats": lambda m: _vote(m["again"] > 0.15, m["words"] >= 10 and m["again"] < 0.05),
    "variety": lambda m: _vote(m["words"] >= 40 and m["distinct"] < 3 / m["words"] ** 0.5 * 0.8, m["words"] >= 40 and m["distinct"] > 6 / m["words"] ** 0.5 * 0.8),
    "bars": lambda m: _vote(m["bars"] > 0.1, m["words"] >= 10 and m["bars"] == 0),
    "sentences": lambda m: _vote(m["words"] >= 20 and m["ends"] < 0.01, 0.02 < m["ends"] < 0.5),
    "words": lambda m: _vote(m["words"] >= 10 and not 2.2 < m["length"] < 12, 3 < m["length"] < 9),
}


def pattern(m: dict[str, float]) -> int:
    """All votes as one number, base 3."""
    out = 0
    for vote in LABELLERS.values():
        out = out * 3 + vote(m)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """One row a pattern, one column a heuristic."""
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS) - 1, -1, -1) % 3


class LabelModel:
    """rates[k, c, v]: how often heuristic k, if it votes, votes v on texts of class c (0 bad, 1 good); prior: the share of good texts. To abstain says nothing."""

    def __init__(self, rates: np.ndarray, prior: float):
        self.rates, self.prior = rates, prior

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
        votes = votes_of(patterns)
        # at first a text is bad as far as more heuristics call it so than one would by chance
        bad, good = (votes == BAD).sum(axis=1), (votes == GOOD).sum(axis=1)
        post = np.where(bad >= 2, 0.05, np.where(bad == 1, 0.4, np.where(good >= 2, 0.98, 0.8)))
        for _ in range(rounds):
            rates = np.empty((votes.shape[1], 2, 3))
            for c, weight in enumerate((counts * (1 - post), counts * post)):
                for v in range(3):
                    rates[:, c, v] = ((votes == v) * weight[:, None]).sum(axis=0) + 0.1
            rates[:, :, NONE] = 0
            rates /= rates.sum(axis=2, keepdims=True)
            rates[:, :, NONE] = 1
            model = cls(rates, float(np.clip((counts * post).sum() / max(1, counts.sum()), 0.02, 0.98)))
            before, post = post, model.posterior(patterns)
            if np.abs(before - post).max(initial=0) < 1e-6:
                break
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text of each pattern is good."""
        votes = votes_of(patterns)
        log = np.log([1 - self.prior, self.prior])[None, :] + sum(np.log(self.rates[k][:, votes[:, k]]).T for k in range(votes.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


_CLASSES = bytes(88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class _Shapes(dict):
    """Words to the feature of their shape: kinds of characters, runs shortened."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST:
            self.clear()
        shape = _RUNS.sub(rb"\1\1", word.translate(_CLASSES))
        out = self[word] = xxhash.xxh3_64_intdigest(shape) % DIMS
        return out


_shapes = _Shapes()


def features(words: list[bytes], m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, and each measure in steps."""
    found, n = np.unique(np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words)), return_counts=True)
    expected = m["distinct"] * max(1.0, m["words"]) ** 0.5
    steps = [f"{k} {min(40, int(v * 20))}" for k, v in m.items() if k not in ("words", "length")] + [f"length {min(15, int(m['length']))}", f"variety {min(40, int(expected))}"]
    own = np.array([xxhash.xxh3_64_intdigest(s) % DIMS for s in steps])
    return np.concatenate([found, own]), np.concatenate([n / max(1, len(words)), np.full(len(own), 0.5)])


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray, times: np.ndarray, rounds: int = 200, rate: float = 0.3, ridge: float = 1e-5) -> Scorer:
        """Logistic regression on soft labels of rows that each count ``times``, by gradient steps scaled to each feature's past gradients."""
        if not rows:
            return cls(np.zeros(DIMS), 1.0)
        at, values = (np.concatenate(x) for x in zip(*rows))
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        weights, bias, past, past_bias = np.zeros(DIMS), 0.0, np.full(DIMS, 1e-8), 1e-8
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, values * weights[at], len(rows)) + bias, -50, 50)))
            error = (p - goal) * times / times.sum()
            step = np.bincount(at, values * error[row], DIMS) + ridge * weights
            past, past_bias = past + step**2, past_bias + error.sum() ** 2
            weights, bias = weights - rate * step / np.sqrt(past), bias - rate * error.sum() / past_bias**0.5
        return cls(weights, bias)

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(values @ self.weights[at] + self.bias, -50, 50))))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [pattern(measures(t, t.split())) for t in (x.as_py() for x in batch["bytes"])]
        kinds, n = np.unique(np.array(found, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["pattern", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for n, text in zip(batch["n"].to_pylist(), (x.as_py() for x in batch["bytes"])):
            m = measures(text, words := text.split())
            at, values = features(words, m)
            out.append((n, pattern(m), at.tobytes(), values.tobytes()))
        columns = zip(*out) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["n", "pattern", "at", "values"])


class QualityModel:
    def __init__(self, labels: LabelModel, scorer: Scorer):
        self.labels, self.scorer = labels, scorer
        self.posterior = labels.posterior(np.arange(3 ** len(LABELLERS)))

    def judge(self, text: bytes) -> tuple[float, float]:
        """Posterior by votes, score of the trained scorer."""
        m = measures(text, words := text.split())
        return float(self.posterior[pattern(m)]), self.scorer.score(*features(words, m))


def fit(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Votes are counted over all texts; the ``sample`` different texts of the least hashes fit the scorer, each weighed by its number of copies."""
    texts = docs.select(text_bytes().alias("bytes"))
    counts = texts.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    labels = LabelModel.fit(counts["pattern"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))
    hashed = F.xxhash64("bytes", F.lit(11)).alias("h")
    chosen = texts.groupBy(hashed).agg(F.count("*").alias("n")).orderBy("h").limit(sample)  # at most ``sample`` rows: small enough to broadcast
    one = texts.withColumn("h", hashed).join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("n").alias("n"), F.first("bytes").alias("bytes"))
    rows = one.select("n", "bytes").mapInArrow(_examples, "n long, pattern long, at binary, values binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["at"], r["values"], r["n"]))
    goal = labels.posterior(np.array([r["pattern"] for r in rows], np.int64))
    return QualityModel(labels, Scorer.fit([(np.frombuffer(r["at"], np.int64), np.frombuffer(r["values"])) for r in rows], goal, np.array([r["n"] for r in rows], float)))


def _judged(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    judge = model.value.judge
    for batch in batches:
        found = [judge(x.as_py()) for x in batch["bytes"]]
        more = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[1] >= KEEP for f in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch["row"], *more], ["row", *JUDGED])


JUDGED = ["quality_weak", "quality_score", "quality_keep"]


def classify(docs: DataFrame, model: QualityModel | None = None, text: str = "text") -> DataFrame:
    """``docs`` with quality_weak (posterior by votes), quality_score and quality_keep (score of KEEP or more).

    Null texts count as empty, on which most heuristics abstain. Equal texts and
    repeated rows are judged alike; very long texts are read whole. All other
    columns stay, but for earlier ones of the three names, which are replaced.
    An empty table gives no rows.
    """
    model = model or fit(docs.select(F.col(text).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in JUDGED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text_bytes(text).alias("bytes"))
    kinds = [StructField("row", rows.schema["row"].dataType), StructField("quality_weak", DoubleType()), StructField("quality_score", DoubleType()), StructField("quality_keep", BooleanType())]
    return rows.mapInArrow(lambda it: _judged(it, shared), StructType(kinds)).select("row.*", *JUDGED)
