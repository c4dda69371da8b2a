"""Removal of repeated strings by suffix arrays over the places where repeats can be.

Every window of ``WIDTH`` bytes is assigned to the least hash among its
``GRAM``-byte parts: its anchor. Equal windows have equal anchors at equal
places, so only windows of one anchor can be equal, and an anchor that occurs
once has no repeats. Neighbouring windows of one anchor make a snippet. Equal
snippets are counted; where an anchor has several different ones, their windows
are sorted as suffixes, in two stages, and common prefixes of neighbours in
that order tell which windows repeat. Of an anchor with too many different
snippets for one array, blocks of neighbouring windows are counted by a digest
of their bytes; windows one by one where blocks differ that share their core.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import text_bytes, written

WIDTH = 200
GRAM = 64
#: Bytes of text hashed at a time, if documents allow.
_RUN = 1 << 20
#: Rows in a batch of cut snippets and windows, about.
_ROWS = 50_000
#: Snippets in one suffix array, about.
SNIPPETS = 3000
#: Of an anchor with more different snippets each window is counted by its digest; no task has to hold them together.
HOT = 2000
#: Neighbouring windows of a hot anchor that are counted together.
BLOCK = 8
#: Places of equal snippets in one row, at most.
PACK = 4096
#: What the removal returns of each text.
REMOVED = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
#: Places within a run, of at most _RUN bytes or of texts that end to end have no more.
_PLACE = np.uint64((1 << 21) - 1)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BASE = 0xD1342543DE82EF95
_BYTES = np.random.default_rng(1).integers(1, 2**63, 256).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            steps = np.ones((2, n + 2), np.uint64)
            steps[:, 1:] = np.array([[_BASE], [pow(_BASE, -1, 2**64)]], np.uint64)
            cls.up, cls.down = np.cumprod(steps, axis=1, dtype=np.uint64)
        return cls.up, cls.down


def snippets(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts that lie end to end in ``data``, less than 2**21 bytes: each snippet's first window, number of windows, anchor's place in the first, anchor's hash and snippet's hash."""
    none = np.empty(0, np.int64)
    if len(data) < width:
        return none, none, none, none, none
    up, down = _Powers.to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    hashes = _mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while have < span:  # least of ever more neighbours; the lower place wins a tie
        more = min(have, span - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
    starts = np.arange(len(least))
    ends_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(least)]
    inside = starts + width <= ends_of
    anchors = np.where(inside, (least & _PLACE).astype(np.int64), -1 - starts)
    cut = np.flatnonzero(np.diff(anchors)) + 1
    first = np.concatenate([[0], cut])
    n = np.diff(np.concatenate([first, [len(anchors)]]))
    first, n = first[inside[first]], n[inside[first]]
    anchor = anchors[first]
    whole = (sums[first + n - 1 + width] - sums[first]) * down[first]
    place = anchor - first
    return first, n, place, hashes[anchor].astype(np.int64), _mix(whole + (n * 1024 + place).astype(np.uint64) * _M[0]).astype(np.int64)


def _texts(column: pa.Array, run: int = _RUN, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Runs of a batch's texts: their bytes end to end, their ends, the first one's number, the run's place in it.

    A text longer than ``run`` is given in several, each ``width`` - 1 bytes
    into the next, so that each window lies in exactly one.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + run, side="right")) - 1)
        b = min(b, len(column))
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= run:
            yield data[lo:hi], (offsets[a + 1 : b + 1] - lo).astype(np.int64), a, 0
        else:
            for at in range(0, hi - lo - width + 1, run):
                part = data[lo + at : min(hi, lo + at + run + width - 1)]
                yield part, np.array([len(part)]), a, at
        a = b


def _packed(row: np.ndarray, at: np.ndarray, key: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """One place of each different snippet, and a list of its other places (null if it has none), so that a common line is few rows wherever it is joined."""
    order = np.lexsort((digest, key))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(digest[order]) != 0)
    starts = np.flatnonzero(new)
    new |= (np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))) % PACK == 0
    starts = np.flatnonzero(new)
    others = np.diff([*starts, len(order)]) - 1
    rest = order[~new]
    places = pa.StructArray.from_arrays([pa.array(row[rest], pa.int64()), pa.array(at[rest], pa.int64())], ["row", "at"])
    more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(others)]), pa.int32()), places, mask=pa.array(others == 0))
    back = np.argsort(order[starts])
    return order[starts][back], more.take(pa.array(back))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch["row"].to_numpy()
        for data, ends, a, before in _texts(batch["bytes"].cast(pa.binary())):
            first, n, place, key, digest = snippets(data, ends)
            doc = np.searchsorted(ends, first, side="right")
            at = first - np.concatenate([[0], ends])[doc] + before
            one, more = _packed(rows[a + doc], at, key, digest)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[one]) for x in (rows[a + doc], at, (n << 8 | place), key, digest)), more], ["row", "at", "shape", "anchor", "digest", "more"])


def two_stage_order(text: np.ndarray, ends: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The first ``counts`` suffixes of each piece of ``text``, in order of ``width`` bytes; a piece's end comes before any byte.

    Directly sorted are suffixes smaller than their successors. The others
    begin with a run of one byte and then a smaller one: bucket by bucket, from
    the least first byte on, their order follows from the run's length and the
    rank of what is after it, which has been placed already.
    """
    starts = np.concatenate([[0], ends[:-1]])
    n = len(text)
    wide = np.append(text.astype(np.int16), -1)
    last = np.zeros(n + 1, bool)
    last[ends - 1] = True
    same = np.append((wide[:-1] == wide[1:])[:n], False) & ~last
    run_end = np.flatnonzero(~same[:n])
    after = run_end[np.searchsorted(run_end, np.arange(n))] + 1  # what follows the run
    closes = last[after - 1]
    follows = np.where(closes, -1, wide[np.minimum(after, n - 1)])
    smaller = follows > text  # than its successor
    stop = np.flatnonzero(smaller | last[:n])
    limit = stop[np.searchsorted(stop, starts + counts - 1)]  # up to a suffix that is sorted directly, or the end
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, limit + 1, -1)
    used = np.cumsum(change)[:n] > 0
    direct = np.flatnonzero(used & smaller)
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    piece_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    keys = np.lib.stride_tricks.sliding_window_view(padded, width)[direct].copy()
    short = piece_end[direct] - direct < width
    if short.any():
        keys[short] *= np.arange(width)[None, :] < (piece_end[direct[short]] - direct[short])[:, None]
    direct = direct[np.argsort(keys.view(f"S{width}").ravel(), kind="stable")]
    induced = np.flatnonzero(used & ~smaller)
    rank = np.full(n + 1, -1, np.int64)
    byte_of = text[direct]
    base = 0
    by_byte = induced[np.argsort(text[induced], kind="stable")]
    edges = np.searchsorted(text[by_byte], np.arange(257))
    edges_direct = np.searchsorted(byte_of, np.arange(257))
    for c in range(256):
        own = by_byte[edges[c] : edges[c + 1]]
        if len(own):
            below = np.where(closes[own], -1, rank[np.minimum(after[own], n)])
            rank[own[np.lexsort((below, after[own] - own))]] = base + np.arange(len(own))
            base += len(own)
        own = direct[edges_direct[c] : edges_direct[c + 1]]
        rank[own] = base + np.arange(len(own))
        base += len(own)
    order = np.empty(base, np.int64)
    placed = np.flatnonzero(rank[:n] >= 0)
    order[rank[placed]] = placed
    window = np.zeros(n + 1, np.int64)
    np.add.at(window, starts, 1)
    np.add.at(window, starts + counts, -1)
    return order[np.cumsum(window)[order] > 0]


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Length, ``width`` at most, of the common prefix of each suffix in ``order`` with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(width, np.uint8)]), width)
    for a in range(1, len(order), 65536):
        b = min(len(order), a + 65536)
        equal = views[order[a - 1 : b - 1]] == views[order[a:b]]
        out[a:b] = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
    return out


def repeated(pieces: list[bytes], counts: list[int], width: int = WIDTH) -> np.ndarray:
    """Which of the first ``counts`` windows of each piece occur more than once, one flag a window, piece by piece."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ends, counts = np.cumsum([len(p) for p in pieces]), np.array(counts)
    order = two_stage_order(text, ends, counts, width)
    alike = common_prefixes(text, order, width) >= width
    alike |= np.append(alike[1:], False)
    starts = np.concatenate([[0], ends[:-1]])
    flags = np.zeros(len(text) + 1, bool)
    flags[order[alike]] = True
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return flags[at]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the snippets to be sorted; of those of a hot anchor, blocks of windows.

    A block's windows, ``n`` from number ``skip`` on, are those whose anchor
    lies at one of ``BLOCK`` places. ``core``: digest of what all windows of
    such places have in common; ``whole``: of all bytes. Equal windows are in
    blocks of one core.
    """
    names = ["anchor", "digest", "skip", "n", "data", "core", "whole"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    told = lambda said, *by: blake2b(said + bytes(by), digest_size=16).digest()
    for batch in batches:
        out: list[tuple] = []
        record = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)
        for data, wanted in zip(batch["bytes"], batch["wanted"].to_pylist()):
            data = data.as_py()
            for w in wanted:
                n, at = w["shape"] >> 8, w["at"]
                if w["hot"]:
                    place = w["shape"] & 255
                    for low in range((place - n + 1) // BLOCK * BLOCK, place + 1, BLOCK):  # places of the anchor in a window
                        a, b = max(low, place - n + 1), min(low + BLOCK - 1, place)
                        block = data[at + place - b : at + place - a + WIDTH]
                        core = data[at + place - low : at + place - low - BLOCK + 1 + WIDTH]
                        out.append((w["anchor"], w["digest"], place - b, b - a + 1, block, told(core, low), told(block, a, b)))
                else:
                    out.append((w["anchor"], w["digest"], 0, n, data[at : at + n - 1 + WIDTH], None, None))
                if len(out) >= _ROWS:
                    yield record()
                    out = []
        yield record()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each window of a block."""
    for batch in batches:
        out = []
        for anchor, digest, skip, n, data in zip(*(batch[c].to_pylist() for c in ("anchor", "digest", "skip", "n", "data"))):
            out += [(anchor, digest, skip + k, blake2b(data[k : k + WIDTH], digest_size=16).digest()) for k in range(n)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["anchor", "digest", "skip", "window"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the windows ``skips`` of each snippet."""
    for batch in batches:
        out = []
        for anchor, digest, skips in zip(*(batch[c].to_pylist() for c in ("anchor", "digest", "skips"))):
            flags = np.zeros(max(skips) + 1, bool)
            flags[skips] = True
            out += [(anchor, digest, int(a), int(b)) for a, b in zip(*_spans(flags))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["anchor", "digest", "a", "b"])


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by anchor, none of them hot: suffix arrays of whole anchors, several together."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        flags = repeated([h[3] for h in held], [h[2] for h in held])
        ends = np.cumsum([h[2] for h in held])
        out: list[tuple] = []
        for (anchor, digest, n, _), end in zip(held, ends):
            for a, b in zip(*_spans(flags[end - n : end])):
                out.append((anchor, digest, int(a), int(b)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["anchor", "digest", "a", "b"])

    before = None
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("anchor", "digest", "n", "data"))):
            if before != row[0] and len(held) >= SNIPPETS:
                yield flush()
            before = row[0]
            held.append(row)
    if held:
        yield flush()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data, spans in zip(batch["bytes"], batch["spans"]):
            data, spans = data.as_py(), spans.as_py()
            kept, removed, n_spans = data, 0, 0
            if spans:
                change = np.zeros(len(data) + 1, np.int32)
                for s in spans:
                    for a, b in s["within"]:
                        change[s["at"] + a] += 1
                        change[s["at"] + b - 1 + WIDTH] -= 1
                gone = np.cumsum(change)[:-1] > 0
                kept, removed, n_spans = np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), len(_spans(gone)[0])
            out.append((len(data), removed, n_spans, sha256(kept).hexdigest(), kept.decode(errors="ignore")))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        rest = batch.drop_columns(["row", "bytes", "spans"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds))], [*rest.schema.names, *REMOVED])


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Removes from each text of ``docs`` (text, ``carry``) the bytes of every ``WIDTH``-byte string that starts more than once in the table.

    Returns ``carry``, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (of the remaining bytes), kept_text (their text, without what
    is left of a character in which a run ends). Strings are judged on the
    input. Null texts are empty; texts of fewer bytes lose nothing; rows
    that repeat a longer text lose it all, none being left as the first. Very
    long texts are hashed in runs of ``_RUN`` bytes. Other columns are left
    out, whatever their names; columns of ``carry`` may have any but the five
    names above. An empty table gives no rows.

    Counts per anchor are partial before they move, and joins back to places
    can be split where an anchor is hot. One copy of each different snippet of
    an anchor is read and sorted, however often it occurs. Equal snippets of a
    run are one row until the last join is done. Blocks of windows of a hot
    anchor are counted by digest, partially before they move, and joined back;
    single windows are counted only of blocks that share their core with
    different ones. What repeats in a snippet is one row, so an occurrence
    meets one.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), text_bytes().alias("bytes"), *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    texts = written(texts, "texts")  # numbers must not change when a part is computed again
    places = written(texts.select("row", "bytes").mapInArrow(_found, "row long, at long, shape long, anchor long, digest long, more array<struct<row:long,at:long>>"), "places")
    times = F.sum(F.when(F.col("more").isNull(), 1).otherwise(F.size("more") + 1)).alias("n")
    stats = places.groupBy("anchor").agg(times, F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("n > 1")
    again = written(places.join(stats.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchor"), "again")
    mixed = again.where("mixed").groupBy("anchor", "digest").agg(times, F.min(F.struct("row", "at", "shape")).alias("one"))
    mixed = written(mixed.select("anchor", "digest", "n", "one.*"), "mixed")
    hot = mixed.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    wanted = mixed.join(hot, "anchor", "left").groupBy("row").agg(F.collect_list(F.struct("at", "shape", "anchor", "digest", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    cut = texts.select("row", "bytes").join(wanted, "row").mapInArrow(_cut_out, "anchor long, digest long, skip int, n int, data binary, core binary, whole binary")
    cut = written(cut, "cut")
    dealt = cut.where("core is null").select("anchor", "digest", "n", "data").repartition("anchor").sortWithinPartitions("anchor")
    alike = dealt.mapInArrow(_sorted, "anchor long, digest long, a long, b long")
    blocks = cut.where("core is not null")
    kinds = blocks.groupBy("core", "whole").agg(F.count("*").alias("times"), F.min(F.struct("anchor", "digest", "skip", "n", "data")).alias("one"))
    kinds = written(kinds, "kinds")
    equal = blocks.join(kinds.where("times > 1").select("whole"), "whole").selectExpr("anchor", "digest", "CAST(skip AS BIGINT) AS a", "CAST(skip + n AS BIGINT) AS b")
    differ = kinds.groupBy("core").count().where("count > 1").select("core")
    windows = written(kinds.join(differ, "core").select("one.*").mapInArrow(_windows, "anchor long, digest long, skip int, window binary"), "windows")
    twice = windows.groupBy("window").count().where("count > 1").select("window")
    skips = windows.join(twice, "window").groupBy("anchor", "digest").agg(F.collect_list("skip").alias("skips"))
    alike = alike.unionAll(equal).unionAll(skips.mapInArrow(_runs, "anchor long, digest long, a long, b long"))
    copies = mixed.where("n > 1").select("anchor", "digest", F.lit(0).cast("long").alias("a"), F.shiftright("shape", 8).alias("b"))
    span = F.array("a", "b")
    alike = written(alike.unionAll(copies).groupBy("anchor", "digest").agg(F.collect_set(span).alias("within")), "alike")
    plain = again.where("not mixed").select("row", "at", "more", F.array(F.array(F.lit(0).cast("long"), F.shiftright("shape", 8))).alias("within"))
    sorted_ = again.where("mixed").join(alike, ["anchor", "digest"]).select("row", "at", "more", "within")
    own = F.array(F.struct("row", "at"))
    each = F.explode(F.when(F.col("more").isNull(), own).otherwise(F.concat(own, "more"))).alias("place")
    spans = plain.unionAll(sorted_).select(each, "within").select("place.*", "within").groupBy("row").agg(F.collect_list(F.struct("at", "within")).alias("spans"))
    fields = [StructField(f"carry_{k}", docs.schema[c].dataType) for k, c in enumerate(carry)]
    more = [StructField(c, StringType() if c.startswith("kept") else LongType()) for c in REMOVED]
    out = texts.join(spans, "row", "left").mapInArrow(_removed, StructType([*fields, *more]))
    return out.withColumnsRenamed({f"carry_{k}": c for k, c in enumerate(carry)})
