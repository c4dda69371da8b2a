"""Whitening by the principal components of a compensated covariance.

Entries become integers, so sums are exact, and so is the mean as a ratio. A
centred entry is a double-double: a high part and what it leaves out. Outer
products are summed without error: a block of rows is sliced into parts of so
few bits that the matrix products of any two are exact in doubles, and each
such product is added to a running double-double by the two-sum. Tasks send the
high and low parts of their sums; these are merged in the same way.

The covariance is reduced to tridiagonal form and solved by divide and conquer
(LAPACK's ``syevd``). Eigenpairs are then refined against the double-double
covariance, so small eigenvalues beside large ones keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Bits of a slice, rows of a block (so that 2 * BITS and the rows' bits fit 53), and slices of a double-double.
BITS, ROWS, SLICES = 20, 4096, 6
#: Entries of all models that go to every task: vectors of ever new lengths would make ever more of them.
MODELS = 1 << 24
#: Least share of the greatest variance that counts as one: below it is what rounding leaves of a dependent entry.
NO_VARIANCE = 1e-24

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and what rounding left out, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(x: Pair, y: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def sliced(x: Pair) -> list[np.ndarray]:
    """A block of double-doubles by columns as SLICES terms of at most BITS + 1 bits each, on one grid a column, greatest first."""
    high, low = x
    out = []
    unit = np.ldexp(1.0, np.frexp(np.abs(high).max(axis=0, initial=0))[1] - BITS)
    for _ in range(SLICES):
        part = np.rint(high / unit) * unit
        out.append(part)
        high, low = two_sum(high - part, low)
        unit = unit * 2.0**-BITS
    return out


def product(x: Pair, y: Pair) -> Pair:
    """x' y of two blocks of double-doubles (rows, columns), rows being at most ROWS: exact products of slices, summed in double-double."""
    left, right = sliced(x), sliced(y)
    out = (np.zeros((x[0].shape[1], y[0].shape[1])),) * 2
    for total in range(2 * SLICES - 2, -1, -1):
        for k in range(max(0, total - SLICES + 1), min(total, SLICES - 1) + 1):
            if total < SLICES:  # what is smaller is below the last bit of a double-double
                out = add(out, (left[k].T @ right[total - k], np.zeros_like(out[0])))
    return out


def centred(x: np.ndarray, total: list[int], n: int) -> Pair:
    """Integers less their mean total / n."""
    mean = [Fraction(t, n) for t in total]
    high = np.array([float(m) for m in mean])
    low = np.array([float(m - Fraction(h)) for m, h in zip(mean, high.tolist())])
    a = two_sum(x.astype(np.float64), -high[None, :])
    return two_sum(a[0], a[1] - low[None, :])


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric double-double matrix."""
    _, first = np.linalg.eigh(high)
    x = first, np.zeros_like(first)
    for _ in range(3):  # each step squares the error
        image = _times(x, _times((high, low), x))
        image = image[0] + image[1]
        for own in _clusters(image):  # what the first solution can't tell apart, the double-double image of it can
            _, turn = np.linalg.eigh(image[np.ix_(own, own)])
            turned = _times((x[0][:, own].T, x[1][:, own].T), (turn, np.zeros_like(turn)))
            x[0][:, own], x[1][:, own] = turned
        gram, image = _times(x, x), _times(x, _times((high, low), x))
        image, rest = image[0] + image[1], (np.eye(len(high)) - gram[0]) - gram[1]
        value = image.diagonal() / (1 - rest.diagonal())
        apart = value[None, :] - value[:, None]
        near = np.abs(apart) <= _unsure(image, value, rest)
        change = np.where(near, rest / 2, (image + value[None, :] * rest) / np.where(near, 1, apart))
        x = add(x, _times((x[0].T, x[1].T), (change, np.zeros_like(change))))
    by = np.argsort(-value, kind="stable")
    return value[by], x[0][:, by]


def _unsure(image: np.ndarray, value: np.ndarray, rest: np.ndarray) -> float:
    """Eigenvalues nearer to each other than this aren't told apart by ``image``."""
    return 2 * (np.linalg.norm(image - np.diag(value)) + np.abs(value).max(initial=0) * np.linalg.norm(rest))


def _clusters(image: np.ndarray) -> list[np.ndarray]:
    value = image.diagonal()
    by = np.argsort(value, kind="stable")
    cut = np.flatnonzero(np.diff(value[by]) > _unsure(image, value, np.zeros_like(image))) + 1
    return [own for own in np.split(by, cut) if len(own) > 1]


def _times(x: Pair, y: Pair) -> Pair:
    """x' y, whatever the number of rows."""
    out = (np.zeros((x[0].shape[1], y[0].shape[1])),) * 2
    for a in range(0, len(x[0]), ROWS):
        out = add(out, product((x[0][a : a + ROWS], x[1][a : a + ROWS]), (y[0][a : a + ROWS], y[1][a : a + ROWS])))
    return out


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Of each batch the vectors of one length as a matrix, at most ROWS rows at a time, with their rows."""
    for batch in batches:
        lengths = batch["x"].value_lengths().to_numpy(zero_copy_only=False)
        values, starts = batch["x"].flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
        for dim in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == dim)
            for a in range(0, len(own), ROWS):
                part = own[a : a + ROWS]
                yield dim, values[starts[part][:, None] + np.arange(dim)], batch.take(pa.array(part))


_PARTS = "dim int, entry int, high binary, low binary"


def _rows_of(found: dict[int, Pair]) -> Iterator[pa.RecordBatch]:
    for dim, (high, low) in found.items():
        columns = [pa.array([dim] * len(high), pa.int32()), pa.array(range(len(high)), pa.int32()), pa.array([h.tobytes() for h in high], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "entry", "high", "low"])


def _outer(batches: Iterator[pa.RecordBatch], fits: dict) -> Iterator[pa.RecordBatch]:
    """A task's sums of outer products, a row an entry of the vectors."""
    found: dict[int, Pair] = {}
    for dim, x, _ in _by_length(batches):
        if dim in fits:
            c = centred(x, fits[dim]["total"], fits[dim]["n"])
            own = product(c, c)
            found[dim] = add(found[dim], own) if dim in found else own
    yield from _rows_of(found)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (dim, entry): their double-double sum."""
    at, held = None, (np.empty(0), np.empty(0))

    def done() -> pa.RecordBatch:
        columns = [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in held)]
        return pa.RecordBatch.from_arrays(columns, ["dim", "entry", "high", "low"])

    for batch in batches:
        for dim, entry, high, low in zip(*(batch[c].to_pylist() for c in ("dim", "entry", "high", "low"))):
            own = np.frombuffer(high), np.frombuffer(low)
            if at is not None and at != (dim, entry):
                yield done()
            held = add(held, own) if at == (dim, entry) else own
            at = dim, entry
    if at is not None:
        yield done()


def _solved(batches: Iterator[pa.RecordBatch], fits: dict, components: int) -> Iterator[pa.RecordBatch]:
    """Rows by (dim, entry): the covariance of each length and its first components."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim, high, low in zip(*(batch[c].to_pylist() for c in ("dim", "high", "low"))):
            held.setdefault(dim, []).append((np.frombuffer(high), np.frombuffer(low)))
        for dim in [d for d in held if len(held[d]) == d]:
            high, low = (np.array(x) for x in zip(*held.pop(dim)))
            n = fits[dim]["n"]
            scaled = high / n, low / n
            rest = [float(Fraction(h) + Fraction(x) - Fraction(q) * n) / n for h, x, q in zip(high.ravel().tolist(), low.ravel().tolist(), scaled[0].ravel().tolist())]
            value, vectors = eigen(scaled[0], np.array(rest).reshape(dim, dim))
            k = int((value[:components] > NO_VARIANCE * max(value[0], 0)).sum()) if value[0] > 0 else 0
            columns = [[dim], [value[:k].tolist()], [float(np.trace(scaled[0]))], [vectors[:, :k].ravel().tolist()]]
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["dim", "value", "trace", "vectors"])


def _projected(x: np.ndarray, fit: dict) -> np.ndarray:
    high, low = centred(x, fit["total"], fit["n"])
    return (high @ fit["vectors"] + low @ fit["vectors"]) / np.sqrt(fit["value"])


def _moments(batches: Iterator[pa.RecordBatch], fits: dict) -> Iterator[pa.RecordBatch]:
    """A task's sums of the whitened rows (the last row) and of their outer products."""
    found: dict[int, Pair] = {}
    for dim, x, _ in _by_length(batches):
        if dim in fits:
            w = _projected(x, fits[dim])
            own = np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])
            found[dim] = add(found[dim], (own, np.zeros_like(own))) if dim in found else (own, np.zeros_like(own))
    yield from _rows_of(found)


def _deviations(x: np.ndarray, total: list[int], n: int) -> list[int]:
    """Of each row the sum of (n x - total) squared, exactly."""
    x = x.astype(object) if n * (int(np.abs(x).max(initial=0)) + 1) >= 2**62 else x
    d = x * n - np.array(total, x.dtype)
    wide = max(int(d.max(initial=0)), -int(d.min(initial=0)))
    d = d if wide * wide * max(1, d.shape[1]) < 2**62 else d.astype(object)
    return (d * d).sum(axis=1).tolist()


def _whitened(batches: Iterator[pa.RecordBatch], fits: dict) -> Iterator[pa.RecordBatch]:
    for dim, x, rows in _by_length(batches):
        if dim not in fits:
            continue
        fit = fits[dim]
        w, k = _projected(x, fit), len(fit["value"])
        deviation = pa.array([Decimal(d) for d in _deviations(x, fit["total"], fit["n"])], pa.decimal128(38, 0))
        of = pa.array(np.repeat(np.arange(len(w)), k))
        columns = [
            rows["vec_id"].take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(w) * k, fit["n"])), deviation.take(of),
            pa.array(w.ravel()), pa.array(np.tile(fit["value"] / fit["trace"], len(w))), pa.array(np.full(len(w) * k, fit["error"])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``vectors`` (vec_id, embedding) and component.

    An entry c counts as floor(SCALE * c) + SHIFT. ``whitened`` is the row less
    the mean, on the unit eigenvector of the component, over the root of its
    eigenvalue; ``deviation`` the exact square of n rows' distance to the mean,
    times n; ``explained`` the eigenvalue's share of the trace;
    ``identity_error`` how far the covariance of what is whitened is from one.

    Vectors that are null, empty, or hold null or non-finite entries take no
    part. Vectors of each length are a list of their own. Components without
    variance (below NO_VARIANCE of the greatest) have no rows: all are such
    where a list has one row, or equal ones. A null vec_id stays; repeated rows
    count each; very long vectors are bounded by a task's memory, which holds
    the square of their length. Entries must stay below 2**52 once scaled; the
    tables of all lengths must have fewer than MODELS entries. Other columns are
    left out, whatever their names; an empty table gives no rows.

    The vectors are read thrice where they were stored; what moves is a square
    matrix a task and length, and one such model a length goes to every task.
    """
    x = F.col("embedding")
    sound = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    rows = written(vectors.where(sound).select("vec_id", ints.alias("x"), F.size(x).alias("dim")), "vectors")
    sums = rows.select("dim", F.posexplode("x").alias("at", "v")).groupBy("dim", "at").agg(F.count("*").alias("n"), F.sum(F.shiftright("v", 26)).alias("high"), F.sum(F.col("v").bitwiseAND(2**26 - 1)).alias("low"), F.max(F.abs("v")).alias("most"))
    fits: dict[int, dict] = {}
    totals = F.array_agg(F.struct("at", "high", "low")).alias("totals")
    for r in sums.groupBy("dim").agg(F.first("n").alias("n"), F.max("most").alias("most"), totals).where(F.col("n") > 1).toLocalIterator():
        if r.most >= 2**52 or sum(d * d for d in (*fits, r.dim)) > MODELS:
            raise ValueError("entries too large, or too many different lengths of vectors")
        fits[r.dim] = {"n": r.n, "total": [(t.high << 26) + t.low for t in sorted(r.totals)]}
    plain = rows.select("vec_id", "x")
    merge = lambda parts: parts.repartition("dim", "entry").sortWithinPartitions("dim", "entry").mapInArrow(_merged, _PARTS)
    covariance = merge(plain.mapInArrow(lambda it: _outer(it, fits), _PARTS)).repartition("dim").sortWithinPartitions("dim", "entry")
    for r in covariance.mapInArrow(lambda it: _solved(it, fits, components), "dim int, value array<double>, trace double, vectors array<double>").collect():
        fits[r.dim] |= {"value": np.array(r.value), "trace": r.trace, "vectors": np.array(r.vectors).reshape(r.dim, len(r.value))}
    fits = {dim: fit for dim, fit in fits.items() if len(fit.get("value", ()))}
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in merge(plain.mapInArrow(lambda it: _moments(it, fits), _PARTS)).collect():
        found.setdefault(r.dim, {})[r.entry] = np.frombuffer(r.high) + np.frombuffer(r.low)
    for dim, sums_of in found.items():
        *outer, total = (sums_of[k] for k in sorted(sums_of))
        n = fits[dim]["n"]
        fits[dim]["error"] = float(np.abs(np.array(outer) / n - np.outer(total / n, total / n) - np.eye(len(total))).max())
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return plain.mapInArrow(lambda it: _whitened(it, fits), f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
