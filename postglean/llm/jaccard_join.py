"""N-gram Jaccard join by prefixes of token combinations.

Sets of word shingles are put in one order for all documents, rare shingles
first: by the frequencies of their words, and last those known to be frequent. Two sets whose Jaccard similarity reaches the threshold differ in few
shingles, so prefixes long enough to outlast these share an index entry: one
rare shingle, or two frequent shingles of one class. In long sets, which have
too many rare shingles from passages that others share, all are dealt to hash
classes, and the entry is the combination of a class's shingles: of more such
classes than shingles that may differ one is the same in both sets. Entries that
two documents share make candidates; exact intersections decide.

Equal sets are one representative from the start. Candidates are first an
entry's documents with its least one, which is linear in the index; only where
an entry then still spans several components are its other pairs compared, in
cells of two blocks. Counts of hashes bound an intersection from above and spare
most pairs the exact one. A cell gives a forest of its open pairs, never all of
them; rows that such forests connect then meet once, with their sets, and give
a forest of verified links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_scratch, made_since, scratch_tables, slices, text_bytes, written
from .components import components

WORDS = 3
#: Similarity in hundredths.
LEAST = 90
#: A shingle as often as this share of all documents, and FEW times at least, is frequent. There are at most (mean words) / share of them.
FREQUENT = 1 / 2000
FEW = 16
#: A word in this share of all words has a weight of its own, others have the least. There are at most 1 / share of them.
WORD_SHARE = 1e-6
#: Hash classes of frequent shingles; a prefix has up to one more shingle for each.
CLASSES = 8
#: Sets of fewer shingles are indexed by single shingles alone, those within the threshold above it both ways.
SHORT = 64
#: Sets of as many shingles are long. Those of one scheme differ in size by GROWTH at most, and have up to DEEP shingles in a class.
LONG = 1024
GROWTH, DEEP = 2.9, 3.6
#: Counts in a set's sketch; of two sets, the lesser counts sum to no less than their intersection.
SKETCH = 256
#: Rows of a block and shingles in all its sets, about; two blocks are compared at a time.
BLOCK = 1024
ITEMS = 1 << 20
#: Hash buckets in which shingles are counted, and chunks in which their table travels.
BUCKETS, CHUNKS = 1 << 22, 64
#: Words with counts that a task holds before it merges them or lets them go.
HELD = 2_000_000
#: Documents compared with one hub in one task's run.
SALT = 256
_MOST = 300_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _Hashes()


class _Weights(dict):
    """Words to the logarithm of their frequency in eighths; words that aren't frequent have 0."""

    def __init__(self, keys: np.ndarray, shares: np.ndarray):
        super().__init__()
        eighths = np.maximum(1, 8 * np.log2(shares / WORD_SHARE)).astype(int) if len(shares) else shares
        self.known = dict(zip(keys.tolist(), eighths.tolist()))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST:
            self.clear()
        out = self[word] = self.known.get(_hashes[word], 0)
        return out


class Order:
    """What the corpus says of shingles' frequency: sorted hashes of frequent ones, and weights of words."""

    def __init__(self, width: int, frequent: np.ndarray, words: np.ndarray, shares: np.ndarray):
        self.width, self.frequent, self.words, self.shares, self.weights = width, frequent, words, shares, None

    def __getstate__(self):
        return self.__dict__ | {"weights": None}

    def ranked(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """A text's shingles, sorted by hash; the same in the common order; how many of these aren't frequent."""
        if self.weights is None:
            self.weights = _Weights(self.words, self.shares)
        found = text.lower().split()
        items = _rolled(_hashed(found), self.width)
        weights = np.fromiter(map(self.weights.__getitem__, found), np.int32, len(found))
        weights = weights[: len(items)] if len(found) < self.width else np.lib.stride_tricks.sliding_window_view(weights, self.width).sum(axis=1)
        items, first = np.unique(items, return_index=True)
        at = np.searchsorted(self.frequent, items)
        often = self.frequent[np.minimum(at, len(self.frequent) - 1)] == items if len(self.frequent) else np.zeros(len(items), bool)
        return items, items[np.lexsort((items, weights[first], often))], len(items) - int(often.sum())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[3]
    x = (x ^ (x >> np.uint64(27))) * _M[4]
    return x ^ (x >> np.uint64(31))


def _hashed(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def _rolled(h: np.ndarray, words: int) -> np.ndarray:
    width = min(words, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = _mix(out * _M[0] + h[k : len(h) - width + 1 + k])
    return out


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes. ``bytes`` lower-cases A-Z and splits at 0x20 and 0x09-0x0D alone."""
    return np.unique(_rolled(_hashed(text.lower().split()), words))


def combined(items: np.ndarray, least: int, k: int) -> tuple[np.ndarray, bool]:
    """Entries of a long set: combinations of the shingles of each hash class that has ``k`` or more.

    There is a scheme of classes for sizes from LONG times each power of GROWTH
    on; sets within the threshold below a scheme's sizes are in it too. Of two
    similar sets the larger one, of b shingles, differs in 2b(1-t)/(1+t) at most.
    If it has more combinations than that (the second value), one is common.
    """
    n, scheme, out, enough = len(items), max(0, int(math.log(len(items) / LONG, GROWTH)) - 1), [], True
    while True:
        low = LONG * GROWTH**scheme
        if 100 * n < least * low:
            break
        if n < low * GROWTH:
            seed = np.uint64((scheme + 1) * int(_M[4]) % 2**64)
            classes = (_mix(items + seed) % np.uint64(math.ceil(low * GROWTH / DEEP))).astype(np.int64)
            by = np.argsort(classes, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(classes[by]) != 0]))
            sizes = np.diff(np.append(first, n))
            sums = np.add.reduceat(_mix(items[by] * _M[2] + _M[1]), first)
            found = _mix(sums + classes[by][first].astype(np.uint64) * _M[0] + seed)[sizes >= k]
            out.append(found)
            enough &= n < low or len(found) * (100 + least) > 2 * (100 - least) * n
        scheme += 1
    return np.concatenate(out) if out else items[:0], enough


def entries(order: np.ndarray, rare: int, least: int = LEAST, k: int = 2) -> tuple[np.ndarray, bool]:
    """Index entries of a set in the common order, of which the first ``rare`` aren't frequent; and whether its combinations are enough (``k`` of 0: there are none).

    At most ``spare`` of its shingles are missing from any set as similar. A
    prefix in which the rare shingles, and in each class the frequent ones less
    one, number more than that keeps a rare one or two of a class in common.
    """
    n = len(order)
    if not n:
        return order, True
    spare = n - -(-least * n // 100)
    out, enough = [], True
    if 100 * SHORT > least * n:
        out.append(_mix(order[: spare + 1] + _M[1]))
    if n >= SHORT and (not k or least * n < 100 * LONG):
        out.append(_mix(order[: min(rare, spare + 1)] + _M[0]))
        if rare <= spare:
            tail = order[rare:]
            kind = (tail >> np.uint64(61)).astype(int) % CLASSES
            first = np.zeros(len(tail), bool)
            first[np.unique(kind, return_index=True)[1]] = True
            end = int(np.searchsorted(np.cumsum(~first), spare + 1 - rare)) + 1
            for c in range(CLASSES):
                own = tail[:end][kind[:end] == c]
                a, b = np.triu_indices(len(own), 1)
                out.append(_mix(own[a] * _M[2] + own[b]))
    if k and 100 * n >= least * LONG:
        found, enough = combined(np.sort(order), least, k)
        out.append(found)
    return np.unique(np.concatenate(out)), enough


def _tallied(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Counts over the whole task: words (kind 1; kind 2 holds their sum), and shingles by hash bucket, in compressed chunks (kind 0)."""
    table, held, total = np.zeros(BUCKETS, np.uint32), [], 0

    def rows(kind: int, items: np.ndarray, n: np.ndarray, data: list | None = None) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(items), kind, np.int32)), pa.array(items.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(data or [None] * len(items), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "item", "n", "data"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        found, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return found, np.bincount(back, np.concatenate([h[1] for h in held]), len(found))

    for batch in slices(batches, 2000):
        words = _hashed(list(chain.from_iterable(x.as_py().lower().split() for x in batch["bytes"])))
        np.add.at(table, (_rolled(words, width) % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))  # shingles across two texts are too few to matter
        held.append(np.unique(words, return_counts=True))
        total += len(words)
        if sum(len(h[0]) for h in held) > HELD:
            held[:] = [merged()]
            if len(held[0][0]) > HELD // 2:
                yield rows(1, *held.pop())
    if held:
        yield rows(1, *merged())
    yield rows(2, np.zeros(1), np.array([total]))
    yield rows(0, np.arange(CHUNKS), np.zeros(CHUNKS), [zlib.compress(c.tobytes(), 1) for c in table.reshape(CHUNKS, -1)])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by chunk: one a chunk, the sum."""
    chunk, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["item", "data"])

    for batch in batches:
        for item, data in zip(batch["item"].to_pylist(), batch["data"]):
            own = np.frombuffer(zlib.decompress(data.as_py()), np.uint32 if len(batch.schema) == 3 else np.int64)
            if item != chunk and chunk is not None:
                yield row()
            total = own.astype(np.int64) if item != chunk else total + own
            chunk = item
    if chunk is not None:
        yield row()


def _in_heavy(batches: Iterator[pa.RecordBatch], width: int, heavy) -> Iterator[pa.RecordBatch]:
    """Counts, by batch, of the shingles whose bucket is heavy."""
    for batch in slices(batches, 2000):
        items = _rolled(_hashed(list(chain.from_iterable(x.as_py().lower().split() for x in batch["bytes"]))), width)
        found, n = np.unique(items[heavy.value[(items % np.uint64(BUCKETS)).astype(np.int64)]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n)], ["item", "n"])


def build_order(texts: DataFrame, words: int = WORDS) -> Order:
    """Frequent shingles and words of all texts; both lists have a bounded share of the corpus.

    Words are counted in full, task by task. Shingles are counted by hash bucket first, in a
    table of fixed size a task, added up in two steps; those in buckets as heavy
    as a frequent shingle are then counted in full.
    """
    spark, width = texts.sparkSession, words
    least = max(FEW, FREQUENT * texts.count())
    tallied = written(texts.select("bytes").mapInArrow(lambda it: _tallied(it, width), "kind int, item long, n long, data binary").withColumn("part", F.spark_partition_id()), "tallied")
    salts = math.isqrt(tallied.agg(F.max("part")).first()[0] or 0) + 1
    parts = tallied.where("kind = 0").select("item", F.pmod("part", F.lit(salts)).alias("salt"), "data")
    sums = parts.repartition("item", "salt").sortWithinPartitions("item", "salt").mapInArrow(_summed, "item long, data binary")
    sums = sums.repartition("item").sortWithinPartitions("item").select("item", "data").mapInArrow(_summed, "item long, data binary")
    heavy = np.zeros((CHUNKS, BUCKETS // CHUNKS), bool)
    for row in sums.toLocalIterator():
        heavy[row.item] = np.frombuffer(zlib.decompress(row.data), np.int64) >= least
    shared = spark.sparkContext.broadcast(heavy.ravel())
    counts = texts.select("bytes").mapInArrow(lambda it: _in_heavy(it, width, shared), "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= least).select("item").toArrow()["item"].to_numpy()
    total = tallied.where("kind = 2").agg(F.sum("n")).first()[0] or 1
    words = tallied.where("kind = 1").groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= WORD_SHARE * total).toArrow()
    return Order(width, np.sort(found.astype(np.uint64)), words["item"].to_numpy().astype(np.uint64), words["n"].to_numpy() / total)


INDEX = "row long, doc_id long, n long, digest binary, sketch binary, entries array<long>, enough boolean"


def _indexed(batches: Iterator[pa.RecordBatch], order, least: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ranked = [order.value.ranked(x.as_py()) for x in batch["bytes"]]
        found, enough = zip(*(entries(ranks, rare, least, k) for _, ranks, rare in ranked)) if ranked else ((), ())
        found = [x.astype(np.int64) for x in found]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s, *_ in ranked], pa.binary())
        sketches = [np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes() for s, *_ in ranked]
        columns = [batch["row"], batch["doc_id"], pa.array([len(s) for s, *_ in ranked], pa.int64()), digests, pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(enough, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "digest", "sketch", "entries", "enough"])


def similar(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether two sorted sets reach the threshold. They are compared range by range of hashes, until what is left can't."""
    if len(a) < 256:
        same = len(a) + len(b) - len(np.union1d(a, b))
        return 100 * same >= least * (len(a) + len(b) - same)
    cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    starts, stops = ([0, *np.searchsorted(x, cuts).tolist(), len(x)] for x in (a, b))
    same = 0
    for k in range(16):
        x, y = a[starts[k] : starts[k + 1]], b[stops[k] : stops[k + 1]]
        if len(x) and len(y):
            same += int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        most = same + min(len(a) - starts[k + 1], len(b) - stops[k + 1])
        if 100 * most < least * (len(a) + len(b) - most):
            return False
    return True


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array([shingles(x.as_py(), words).tobytes() for x in batch["bytes"]], pa.binary())], ["row", "items"])


def _verified(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Runs of one hub's set and the sets to compare with it, the hub first."""
    hub, own = None, None
    for batch in batches:
        a, b = [], []
        for h, r, items in zip(batch["hub"].to_pylist(), batch["row"].to_pylist(), batch["items"]):
            items = np.frombuffer(items.as_py(), np.uint64)
            if h == r:
                hub, own = h, items
                continue
            assert h == hub
            if similar(own, items, least):
                a.append(h)
                b.append(r)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches leave the threshold open. A full count leaves its part open."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int64) for c in ("sketch_a", "sketch_b"))
        sizes = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
        same = np.minimum(a, b).sum(axis=1)
        keep = (100 * same >= least * (sizes - same)) | ((a == 255) & (b == 255)).any(axis=1)
        yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep)) for c in ("hub", "row")], ["hub", "row"])


def _open_pairs(pairs: DataFrame, index: DataFrame, least: int) -> DataFrame:
    a, b = (index.select(F.col("row").alias(c), F.col("n").alias(f"n_{x}")) for c, x in (("hub", "a"), ("row", "b")))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * least
    sized = written(pairs.join(a, "hub").join(b, "row").where(near), "sized")  # before sketches move
    a, b = (index.select(F.col("row").alias(c), F.col("sketch").alias(f"sketch_{x}")) for c, x in (("hub", "a"), ("row", "b")))
    return written(sized.join(a, "hub").join(b, "row").mapInArrow(lambda it: _possible(it, least), "hub long, row long"), "possible")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """Those of ``pairs`` (hub, row) that reach the threshold, as (a, b). A hub of many pairs is dealt to several runs."""
    wanted = pairs.select("row").unionAll(pairs.select("hub")).distinct()
    sets = written(texts.select("row", "bytes").join(wanted, "row", "left_semi").mapInArrow(lambda it: _sets(it, words), "row long, items binary"), "sets")
    runs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT).alias("runs"))
    members = pairs.join(runs, "hub").select("hub", F.pmod("row", "runs").alias("run"), "row")
    hubs = runs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.col("hub").alias("row"))
    dealt = hubs.unionAll(members).join(sets, "row").repartition("hub", "run").sortWithinPartitions("hub", "run", F.col("row") != F.col("hub"))
    return written(dealt.select("hub", "row", "items").mapInArrow(lambda it: _verified(it, least), "a long, b long"), "verified")


CELL = ["entry", "i", "j", "second", "row", "n", "root", "sketch"]


def _by_cell(batches: Iterator[pa.RecordBatch], last: str) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """Rows (row, n, root, sketch, ``last``) of each cell's two blocks, of which one is empty where the cell has a single block. Rows come by cell, the first block first."""
    cell, held = None, ([], [])
    for batch in batches:
        for entry, i, j, second, *row in zip(*(batch[c].to_pylist() for c in [*CELL, *([last] if last else [])])):
            if (entry, i, j) != cell:
                if cell and held[0]:
                    yield cell, *held
                cell, held = (entry, i, j), ([], [])
            held[second].append(tuple(row))
    if cell and held[0]:
        yield cell, *held


class _Block:
    def __init__(self, rows: list[tuple]):
        self.rows, self.sizes, self.roots = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, SKETCH)

    def open(self, n: int, sketch: np.ndarray, near: np.ndarray, least: int) -> np.ndarray:
        """Of the places ``near``, those whose size and sketch leave the threshold with a set of ``n`` open. A full count leaves its part open."""
        near = near[100 * np.minimum(self.sizes[near], n) >= least * np.maximum(self.sizes[near], n)]
        same = np.minimum(self.sketches[near], sketch).sum(axis=1, dtype=np.int64)
        full = (self.sketches[near] == 255).any(axis=1) & bool((sketch == 255).any())
        return near[(100 * same >= least * (self.sizes[near] + n - same)) | full]


def _open_forest(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of each cell's open pairs across components those of a spanning forest, fewer than its rows. They tell which rows must meet."""
    for (_, i, j), first, second in _by_cell(batches, ""):
        if i != j and not second:
            continue
        one, a = i == j, _Block(first)
        b = a if one else _Block(second)
        known = {x: k for k, x in enumerate(dict.fromkeys([*a.rows.tolist(), *b.rows.tolist()]))}
        up, left, right = list(range(len(known))), [], []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for k in range(len(a.rows)):
            near = np.flatnonzero(b.roots != a.roots[k])
            near = b.open(int(a.sizes[k]), a.sketches[k], near[near > k] if one else near, least)
            for m in near.tolist():
                x, y = top(known[int(a.rows[k])]), top(known[int(b.rows[m])])
                if x != y:
                    up[y] = x
                    left.append(int(a.rows[k]))
                    right.append(int(b.rows[m]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links of each cell that join two of its components, verified: fewer than its rows."""
    for (_, i, j), first, second in _by_cell(batches, "items"):
        one, a = i == j, _Block(first)
        b = a if one else _Block(second)
        sets = [[np.frombuffer(r[4], np.uint64) for r in block] for block in ((first, first) if one else (first, second))]
        roots, left, right = (a.roots.copy(), b.roots.copy()), [], []
        if one:
            roots = roots[0], roots[0]
        for k in range(len(a.rows)):
            near = np.flatnonzero(roots[1] != roots[0][k])
            near = b.open(int(a.sizes[k]), a.sketches[k], near[near > k] if one else near, least)
            for m in near.tolist():
                if roots[1][m] == roots[0][k]:
                    continue
                if similar(sets[0][k], sets[1][m], least):
                    left.append(int(a.rows[k]))
                    right.append(int(b.rows[m]))
                    old, new = roots[1][m], roots[0][k]
                    for side in roots:
                        side[side == old] = new
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _cells(open_: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of entries that still span components, dealt to cells: an entry's rows are in blocks, each two blocks meet in one cell.

    Entries with the same rows, as those of one shared passage, are one. Rows
    are told by two hashes of all of them, so no entry is gathered.
    """
    rows_of = [F.count("*").alias("rows"), F.sum("n").alias("items"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")]
    spans = open_.groupBy("entry").agg(*rows_of, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("items") / ITEMS)).alias("blocks")
    groups = written(spans.groupBy("rows", "items", "x", "y").agg(F.min("entry").alias("entry")).select("entry", blocks), "groups")
    rows = open_.join(groups, "entry").withColumn("b", F.pmod(F.xxhash64("row"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = [F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), (F.col("b") > F.col("other")).cast("int").alias("second")]
    return rows.join(index.select("row", "sketch"), "row").select("entry", *cell, "row", "n", "root", "sketch")


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j", "second", "row")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: int = LEAST, row: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): row (column ``row`` if given, else a number), doc_id, n_shingles, component_id, first.

    Two documents link when ``100 * |A & B| >= least * |A | B|`` for their sets
    of distinct ``words``-word shingles; a text of fewer words is one shingle.
    Texts that are null, empty or without words have no shingles and no links.
    component_id is the least doc_id that links reach (ids that are null don't
    count; null if there's no other); ``first`` marks one row of each
    component, of that id where there is one. Repeated rows link as any equal
    texts do, and of rows of the same least id the least row is first. Very
    long texts are read whole; one text's set must fit in a task. Other columns
    are left out, whatever their names; an empty table gives no rows. A ``row``
    column must be stored, so that its numbers are the same at each reading.
    """
    spark, start = docs.sparkSession, scratch_tables()
    texts = docs.select(F.col(row).alias("row") if row else F.monotonically_increasing_id().alias("row"), "doc_id", text_bytes().alias("bytes"))
    if not row:
        texts = written(texts, "texts")  # numbers must not change when a part is computed again
    order = spark.sparkContext.broadcast(build_order(texts, words))
    for k in (2, 1, 0):  # if ever a long set has too few combinations of two, all index single ones too; then none, but prefixes
        index = written(texts.mapInArrow(lambda it, k=k: _indexed(it, order, least, k), INDEX), "index")
        if not k or not index.where("not enough").limit(1).count():
            break

    same = index.where("digest is not null").groupBy("digest").agg(F.min("row").alias("rep"))
    reps = index.join(same.select(F.col("rep").alias("row")), "row", "left_semi")
    posted = reps.select("row", F.explode("entries").alias("entry")).repartition("entry")  # moves once, for both uses; an entry's rows stream through
    stats = posted.groupBy("entry").agg(F.min("row").alias("hub"), F.count("*").alias("docs")).where("docs > 1")
    shared = written(posted.join(stats, "entry").select("entry", "row", "hub"), "shared")
    pairs = _open_pairs(shared.where(F.col("hub") != F.col("row")).select("hub", "row").distinct(), index, least)
    links = _verify(pairs, texts, words, least)
    clear_scratch(spark, made_since(start, "tallied", "sized", "possible", "sets"))

    roots = components(links)
    rest = shared.where(F.col("hub") != F.col("row")).select("entry", "row").join(index.select("row", "n"), "row")  # the hub has met all others
    open_ = written(rest.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")), "open")
    across = written(_dealt(_cells(open_, index)).mapInArrow(lambda it: _open_forest(it, least), "a long, b long").distinct(), "across")
    met = components(across).select(F.col("root").alias("entry"), F.col("node").alias("row"))  # rows that open pairs connect meet once, not at each entry
    met = met.join(index.select("row", "n"), "row").join(roots.withColumnRenamed("node", "row"), "row", "left")
    met = written(met.select("entry", "row", "n", F.coalesce("root", "row").alias("root")), "met")
    clear_scratch(spark, made_since(start, "shared", "open", "groups", "across"))
    sets = written(texts.select("row", "bytes").join(met.select("row"), "row", "left_semi").mapInArrow(lambda it: _sets(it, words), "row long, items binary"), "across-sets")
    cells = _cells(met, index).join(sets, "row").select(*CELL, "items")
    more = _dealt(cells).mapInArrow(lambda it: _forest(it, least), "a long, b long")
    roots = components(links.unionAll(written(more, "more")))
    clear_scratch(spark, made_since(start, "verified", "more", "met", "groups", "across-sets"))

    own = index.select("row", "doc_id", "n", "digest").join(same, "digest", "left")
    own = own.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep", "row"))
    least_of = own.groupBy("root").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("m"), F.min("row").alias("r"))
    least_of = least_of.select("root", F.col("m.doc_id").alias("component_id"), F.coalesce("m.row", "r").alias("first_row"))
    out = own.drop("rep").join(least_of, "root")
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("first_row")).alias("first"))
