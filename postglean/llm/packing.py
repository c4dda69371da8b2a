"""Best-fit packing by minimum bin slack over a histogram of lengths.

Sequences hold whole numbers of ids, so what a packing needs to know of the
documents is how many pieces of each length there are: at most ``capacity``
counts, however large the table. Each bin is the fullest combination of what is
left, found by a subset-sum over bitsets; it is taken as often as the counts
allow before the next is sought. Pieces then find their place by their number
among those of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes, written
from .tokens import Encoder, default_tokenizer

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest bin of at most ``capacity``: the longest length left, and what of the rest fills it best. Length to number."""
    lengths = sorted((k for k, n in counts.items() if n), reverse=True)
    seed = lengths[0]
    room = capacity - seed
    full, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        have = counts[length] - (length == seed)
        if length > room or not have:
            continue
        left, step = min(have, room // length), 1
        while left:  # copies by doubling numbers: as many shifts as the number has bits
            use = min(step, left)
            trail.append((length, use, reach))
            reach |= (reach << (length * use)) & full
            left, step = left - use, step * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {seed: 1}
    for length, use, before in reversed(trail):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + use
            at -= length * use
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, times, sequence, offset): pieces number first to first + times - 1 of this length go to sequences from ``sequence`` on, at ``offset``."""
    counts, used, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while any(counts.values()):
        found = fullest(counts, capacity)
        times, offset = min(counts[k] // n for k, n in found.items()), 0
        for length, n in sorted(found.items(), reverse=True):
            for _ in range(n):
                rows.append((length, used[length], times, sequence, offset))
                used[length] += times
                offset += length
            counts[length] -= n * times
        counts = {k: n for k, n in counts.items() if n}
        sequence += times
    return rows


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, encoder, seen = TaskContext.get().partitionId(), Encoder.of(tokenizer), np.zeros(capacity + 1, np.int64)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["bytes"]):
            ids = encoder.ids(text.as_py().decode()) + end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, seen[b - a]))
                seen[b - a] += 1
        columns = zip(*rows) if rows else [[]] * 7
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])


def _placed(batches: Iterator[pa.RecordBatch], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """rows: the plan sorted by (length, first)."""
    span = int(rows[:, 1].max()) + int(rows[:, 2].max()) + 1
    keys = rows[:, 0] * span + rows[:, 1]
    for batch in batches:
        length, nth = (np.asarray(batch[c]) for c in ("length", "nth"))
        at = np.searchsorted(keys, length * span + nth, side="right") - 1
        sequence = rows[at, 3] + nth - rows[at, 1]
        columns = [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(rows[at, 4])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Packs the ids of ``docs`` (doc_id, text) into sequences of at most ``capacity``.

    Every row is packed, rows of one id or text as often as they occur. Null and
    empty texts are their end id alone; an empty table gives no rows. Only
    documents longer than ``capacity`` are cut, and of their pieces only the
    first may be shorter. Pieces of equal length take places by their number, so
    ties don't matter. Other columns are left out, whatever their names.

    Each task numbers its pieces by length; a running sum over (length, task)
    counts, at most ``capacity`` a task, makes these numbers global. To the
    driver goes the histogram, ``capacity`` rows at most.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", text_bytes().alias("bytes"))
    pieces = written(rows.mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end_id), PIECES), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(sorted(plan(histogram, capacity)) or [(0, 0, 0, 0, 0)], np.int64)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("base"))
    return numbered.mapInArrow(lambda it: _placed(it, table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
