"""Maximal periodic runs of words on a harmonic grid.

A run of exponent ``EXPONENT`` or more with period p holds as many neighbouring
multiples of p. So for each p the multiples jp and (j+1)p are asked how far the
text agrees from them on, forward and backward: both lengths and p make the
run. There are about n ln n such pairs. Where the words at these multiples
differ nothing agrees; the others are asked of a suffix array, of that of the
reversed text, and of range minima over the common prefixes of neighbours in
them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: Least exponent and least length of a run.
EXPONENT = 4
LEAST = 6
#: Words of a text whose grid is kept; pairs of the grid of a longer one that are looked at together.
KEPT = 1 << 15
PAIRS = 1 << 20
BLOCK = 32


def _pairs(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(p, jp) for each period from ``low`` to below ``high``, as long as EXPONENT multiples from jp on lie in ``n`` words."""
    p = np.arange(low, high)
    counts = np.maximum(0, (n - 1) // p - (EXPONENT - 2))
    period = np.repeat(p, counts)
    j = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
    return period, j * period


class _Grid:
    """The grid of short texts by its last multiple: that of a text is a prefix of it."""

    n = 0

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.n < n:
            cls.n = min(KEPT, max(1024, 2 * n))
            period, first = _pairs(cls.n, 1, cls.n // EXPONENT + 1)
            last = first + (EXPONENT - 1) * period
            by = np.argsort(last, kind="stable")
            cls.period, cls.first, cls.last = period[by], first[by], last[by]
        k = int(np.searchsorted(cls.last, n))
        return cls.period[:k], cls.first[:k]


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid of ``n`` words, about ``PAIRS`` pairs at a time."""
    if n <= KEPT:
        yield _Grid.of(n)
        return
    low, most = 1, n // EXPONENT + 1
    while low < most:
        high = min(most, low + max(1, PAIRS * low // n))
        yield _pairs(n, low, high)
        low = high


class _Minima:
    """Least of a range: prefixes and suffixes of blocks, and ever longer rows of blocks."""

    def __init__(self, values: np.ndarray):
        wide = np.append(values, np.full(-len(values) % BLOCK, np.iinfo(values.dtype).max)).reshape(-1, BLOCK)
        self.values = wide.ravel()
        self.to = np.minimum.accumulate(wide, axis=1).ravel()
        self.since = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
        self.rows = [wide.min(axis=1)]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the places from ``a`` to ``b``, both of them included."""
        left, right = a // BLOCK, b // BLOCK
        out = np.minimum(self.since[a], self.to[b])
        between = right - left - 1
        for k, row in enumerate(self.rows):
            own = np.flatnonzero((between >> k) == 1)
            if len(own):
                out[own] = np.minimum(out[own], np.minimum(row[left[own] + 1], row[right[own] - (1 << k)]))
        own = np.flatnonzero(left == right)
        at = a[own][:, None] + np.arange(BLOCK)
        inside = at <= b[own][:, None]
        out[own] = np.where(inside, self.values[np.where(inside, at, 0)], np.iinfo(self.values.dtype).max).min(axis=1)
        return out


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each one's rank: by prefixes that double, those still alike being sorted again."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    places, keys = np.arange(n), words[order]
    rank, k = np.empty(n, np.int64), 1
    while True:
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(keys)))
        suffixes = order[places]
        rank[suffixes] = np.repeat(places[first], sizes)
        alike = np.repeat(sizes > 1, sizes)
        if not alike.any():
            return order, rank
        places, suffixes = places[alike], suffixes[alike]
        after = suffixes + k
        keys = rank[suffixes] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(keys, kind="stable")
        order[places], keys = suffixes[by], keys[by]
        k *= 2


class Agreement:
    """How far a text agrees with itself from two places on."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        order, self.rank = suffix_array(words)
        ranks, listed, before = self.rank.tolist(), words.tolist(), np.append(-1, order[:-1]).tolist()
        listed += [-1]
        prefixes, common, n = [0] * self.n, 0, self.n
        for i, r in enumerate(ranks):  # a suffix agrees with its neighbour by at most one word less than the suffix before it did
            j = before[r]
            if j < 0:
                common = 0
                continue
            a, b = i + common, j + common
            while a < n and b < n and listed[a] == listed[b]:
                a += 1
                b += 1
            common = a - i
            prefixes[r] = common
            common -= common > 0
        self.minima = _Minima(np.array(prefixes, np.int32))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a < b; b may be the text's end."""
        inside = b < self.n
        x, y = self.rank[np.where(inside, a, 0)], self.rank[np.where(inside, b, min(1, self.n - 1))]
        return np.where(inside, self.minima.least(np.minimum(x, y) + (x != y), np.maximum(x, y)), 0)


def _alike(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the grid, where the words at EXPONENT neighbouring multiples are one word."""
    periods, firsts = [], []
    for p, first in grid(len(words)):
        for k in range(EXPONENT - 1):
            own = np.flatnonzero(words[first + k * p] == words[first + (k + 1) * p])
            p, first = p[own], first[own]
        periods.append(p)
        firsts.append(first)
    return np.concatenate(periods), np.concatenate(firsts)


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each maximal run, by start, then period. ``words``: numbers, the same for the same word."""
    n = len(words)
    if n < LEAST:
        return []
    p, first = _alike(words)
    if not len(p):
        return []
    forward = Agreement(words).of(first, first + p)
    backward = Agreement(words[::-1]).of(n - first - p, n - first)
    start, end = first - backward, first + p + forward
    by = np.lexsort((p, end, start))
    p, start, end = p[by], start[by], end[by]
    smallest = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))  # a stretch's other periods are multiples of its smallest
    long = (end - start >= EXPONENT * p) & (end - start >= LEAST)
    found = np.flatnonzero(smallest & long)
    return sorted(zip(start[found].tolist(), (end - start)[found].tolist(), p[found].tolist()), key=lambda r: (r[0], r[2]))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Edit = Callable[[object, list[bytes]], list[bytes]]


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten, by crc32 of its id as text, ends in a loop; one without id doesn't."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _told(batches: Iterator[pa.RecordBatch], edit: Edit | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found, best, collapsed = [], [], []
        for doc_id, data in zip(batch["doc_id"].to_pylist(), batch["bytes"]):
            words = data.as_py().split()
            if edit:
                words = edit(doc_id, words)
            own = runs(np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words)))
            if own:
                change = np.zeros(len(words) + 1, np.int32)
                for start, length, period in own:
                    change[start + period] += 1
                    change[start + length] -= 1
                words = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
            found.append([dict(zip(("start", "length", "period"), r)) for r in own])
            best.append(dict(zip(("start", "length", "period"), max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])))) if own else None)
            collapsed.append(b" ".join(words))
        columns = [batch["doc_id"], pa.array(found, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(collapsed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "best", "collapsed"])


def periodic_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """(doc_id, runs, best, collapsed) for each row of ``docs`` (doc_id, text).

    ``runs``: the maximal stretches of words of smallest period q and at least
    max(LEAST, EXPONENT * q) words, as (start, length, period), by start, then
    period. ``best``: the one of greatest length / period, the first of equals,
    or null. ``collapsed``: the words that no run holds after its first period,
    one space between two. ``edit`` may change a text's words first.

    Words are what ASCII white space separates. Null and empty texts have no
    words; a null doc_id stays; rows that repeat are each told, alike. Very long
    texts are read whole, their grid in parts. Other columns are left out,
    whatever their names; an empty table gives no rows. Nothing is shuffled.
    """
    run = "struct<start:bigint,length:bigint,period:bigint>"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<{run}>, best {run}, collapsed binary"
    out = docs.select("doc_id", text_bytes().alias("bytes")).mapInArrow(lambda it: _told(it, edit), schema)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(found: DataFrame) -> DataFrame:
    """Of the rows of ``periodic_runs``: how many runs, the best one's figures, and digests of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
