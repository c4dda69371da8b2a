"""Exact top-k inner products by vector-approximation files.

Vectors lie in chunks: a small approximation, one cell of ``CELLS`` a component
with each component's least value and step, and apart from it the exact
components. The cells bound every score from below and above. A first scan, of
cells alone, finds each query's kth lower bound over all chunks; a second keeps
what an upper bound leaves open. Exact vectors are read in the order of these
bounds: the best k of a query, then those that could still pass the kth score.

Of equal vectors only the k + 1 of the least ids can be among a query's k best,
so the others aren't held, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 5
EVERY = 50
CELLS = 64
SCALE = 256
#: Components in a chunk, and queries in a block; chunks whose cells one task holds.
COMPONENTS = 1 << 17
BLOCK = 512
HELD = 512
#: In place of a lower bound: none.
NONE = -(2**62)
CHUNKS = "chunk long, dim int, queries boolean, rows binary, ids binary, nulls binary, least binary, step binary, cells binary, vectors binary"
CANDIDATES = "query_row long, query_id long, query binary, chunk long, place int, upper long"
FOUND = "query_row long, query_id long, vec_row long, vec_id long, score long"


def _packed(x: np.ndarray) -> bytes:
    """Integers in the least of 2, 4 or 8 bytes each that holds all of them, which the first byte tells."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[data[0]]
    return np.frombuffer(data[1:], kind).astype(np.int64).reshape(n, dim)


class Approximation:
    """Cells of a chunk's vectors, and what they say of scores."""

    def __init__(self, least: np.ndarray, step: np.ndarray, cells: np.ndarray):
        self.least, self.step, self.cells = least, step, cells

    @classmethod
    def of(cls, vectors: np.ndarray, cells: int = CELLS) -> Approximation:
        least = vectors.min(axis=0)
        step = (vectors.max(axis=0) - least) // cells + 1
        return cls(least, step, ((vectors - least) // step).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each query's score with each vector."""
        low = self.least + self.cells * self.step
        wide = max(1, int(np.abs(low).max(initial=1)) + int(self.step.max(initial=1))) * max(1, int(np.abs(queries).max(initial=1))) * max(1, low.shape[1])
        if wide < 2**52:  # doubles hold these sums exactly; beyond, 64-bit integers do, more slowly
            shared = (queries.astype(np.float64) @ low.T.astype(np.float64)).astype(np.int64)
        else:
            shared = queries @ low.T
        room = self.step - 1
        return shared + (np.minimum(queries, 0) @ room)[:, None], shared + (np.maximum(queries, 0) @ room)[:, None]


def _chunks(batches: Iterator[pa.RecordBatch], queries: bool) -> Iterator[pa.RecordBatch]:
    """Chunks of vectors of one length, with their cells; blocks of queries have none."""
    from pyspark import TaskContext

    number = (TaskContext.get().partitionId() * 2 + queries) << 32
    held: dict[int, list] = {}

    def row(dim: int) -> pa.RecordBatch:
        nonlocal number
        rows, ids, nulls, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
        cells = Approximation.of(vectors) if not queries else Approximation(*[np.empty(0, np.int64)] * 3)
        own = (rows, ids, nulls, cells.least, cells.step, cells.cells)
        number += 1
        columns = [pa.array([number]), pa.array([dim], pa.int32()), pa.array([queries]), *(pa.array([x.tobytes()], pa.binary()) for x in own), pa.array([_packed(vectors)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "dim", "queries", "rows", "ids", "nulls", "least", "step", "cells", "vectors"])

    for batch in batches:
        lengths = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
        values, starts = batch["v"].flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
        rows, ids, nulls = batch["row"].to_numpy(), batch["vec_id"].fill_null(0).to_numpy(zero_copy_only=False), np.asarray(batch["vec_id"].is_null())
        for dim in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == dim)
            most = BLOCK if queries else max(1, COMPONENTS // max(1, dim))
            while len(own):
                now, own = np.split(own, [most - sum(len(h[0]) for h in held.get(dim, []))])
                held.setdefault(dim, []).append((rows[now], ids[now], nulls[now], values[starts[now][:, None] + np.arange(dim)].astype(np.int64)))
                if sum(len(h[0]) for h in held[dim]) >= most:
                    yield row(dim)
    for dim in list(held):
        yield row(dim)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """Rows by (slot, queries): each block of queries with the slot's chunks of the same length."""
    held: list[dict] = []
    slot = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["slot"] != slot:
                slot, held = r["slot"], []
            dim, rows = r["dim"], np.frombuffer(r["rows"], np.int64)
            if not r["queries"]:
                least, step = (np.frombuffer(r[c], np.int64) for c in ("least", "step"))
                cells = np.frombuffer(r["cells"], np.uint8).reshape(len(rows), dim)
                held.append({"chunk": r["chunk"], "dim": dim, "rows": rows, "cells": Approximation(least, step, cells)})
            else:
                own = {"chunk": r["chunk"], "rows": rows, "ids": np.frombuffer(r["ids"], np.int64), "kth": r["kth"]}
                yield own | {"vectors": _unpacked(r["vectors"], len(rows), dim)}, [c for c in held if c["dim"] == dim]


def _own(chunk: dict, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where a query meets itself."""
    _, at, own = np.intersect1d(block["rows"], chunk["rows"], assume_unique=True, return_indices=True)
    return at, own


def _lower(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each block's ``k`` best lower bounds a query over a slot."""
    for block, chunks in _met(batches):
        best = np.full((len(block["rows"]), k), NONE)
        for chunk in chunks:
            lower, _ = chunk["cells"].bounds(block["vectors"])
            lower[_own(chunk, block)] = NONE
            best = np.partition(np.concatenate([best, lower], axis=1), -k, axis=1)[:, -k:]
        yield pa.RecordBatch.from_arrays([pa.array([block["chunk"]]), pa.array([best.tobytes()], pa.binary())], ["chunk", "kth"])


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows by block: each query's kth lower bound over all slots."""
    at, best = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([best.min(axis=1).tobytes()], pa.binary())], ["chunk", "kth"])
    for batch in batches:
        for chunk, data in zip(batch["chunk"].to_pylist(), batch["kth"]):
            own = np.frombuffer(data.as_py(), np.int64).reshape(-1, k)
            if at is not None and chunk != at:
                yield done()
            best = own if chunk != at else np.partition(np.concatenate([best, own], axis=1), -k, axis=1)[:, -k:]
            at = chunk
    if at is not None:
        yield done()


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What an upper bound of no less than the query's kth lower bound leaves open."""
    for block, chunks in _met(batches):
        kth = np.frombuffer(block["kth"], np.int64)
        data = np.array([_packed(v) for v in block["vectors"]], object)
        for chunk in chunks:
            _, upper = chunk["cells"].bounds(block["vectors"])
            near = upper >= kth[:, None]
            near[_own(chunk, block)] = False
            q, v = np.nonzero(near)
            for a in range(0, len(q), 10_000):
                p = slice(a, a + 10_000)
                columns = [block["rows"][q[p]], block["ids"][q[p]], pa.array(data[q[p]], pa.binary()), np.full(len(q[p]), chunk["chunk"]), v[p].astype(np.int32), upper[q[p], v[p]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "query", "chunk", "place", "upper"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by chunk: its exact vectors first, then the candidates among them."""
    held = None
    for batch in batches:
        exact = np.asarray(batch["vectors"].is_valid())
        edges = [0, *np.flatnonzero(exact).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b and exact[a]:
                r = batch.slice(a, 1).to_pylist()[0]
                rows, ids, nulls = (np.frombuffer(r[c], kind) for c, kind in (("rows", np.int64), ("ids", np.int64), ("nulls", bool)))
                held = _unpacked(r["vectors"], len(rows), r["dim"]), rows, ids, nulls
                a += 1
            part = batch.slice(a, b - a)
            if part.num_rows:
                vectors, rows, ids, nulls = held
                place = part["place"].to_numpy()
                queries = np.concatenate([_unpacked(x.as_py(), 1, vectors.shape[1]) for x in part["query"]])
                columns = [part["query_row"], part["query_id"], pa.array(rows[place]), pa.array(ids[place], mask=nulls[place]), pa.array((vectors[place] * queries).sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_row", "vec_id", "score"])


def _scores(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Exact scores of candidates; only chunks that have any are read."""
    fields = ["chunk", "query_row", "query_id", "query", "place"]
    exact = chunks.where("not queries").join(candidates.select("chunk").distinct(), "chunk", "left_semi").select("chunk", "dim", "rows", "ids", "nulls", "vectors")
    both = exact.unionByName(candidates.select(*fields), allowMissingColumns=True).repartition("chunk")
    return both.sortWithinPartitions("chunk", F.col("vectors").isNull()).mapInArrow(_read, FOUND)


def approximated(vectors: DataFrame, k: int = K) -> DataFrame:
    """The stored chunks of ``vectors`` (vec_id, embedding), and blocks of the vectors whose id is divisible by EVERY."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    rows = written(vectors.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v")), "vectors")
    equal = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"), F.size("v")).orderBy(F.col("vec_id").asc_nulls_last(), "row")
    kept = rows.withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k + 1).select("row", "vec_id", "v")
    asks = rows.where(F.col("vec_id") % EVERY == 0)
    return written(kept.mapInArrow(lambda it: _chunks(it, False), CHUNKS).unionAll(asks.mapInArrow(lambda it: _chunks(it, True), CHUNKS)), "chunks")


def candidates(chunks: DataFrame, k: int = K) -> DataFrame:
    """By two scans of the cells: what could be among a query's ``k`` best."""
    spark = chunks.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks.where("not queries").count() // HELD))
    slot = F.pmod(F.xxhash64("chunk"), F.lit(slots).cast("long")).alias("slot")
    cells = chunks.where("not queries").select(slot, "queries", "chunk", "dim", "rows", "least", "step", "cells")
    blocks = chunks.where("queries").select("queries", "chunk", "dim", "rows", "ids", "vectors")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot")

    def scan(asks: DataFrame) -> DataFrame:
        both = cells.unionByName(asks.select(every, "*"), allowMissingColumns=True)
        return both.repartition(slots, "slot").sortWithinPartitions("slot", "queries", "chunk")

    lower = scan(blocks.withColumn("kth", F.lit(None).cast("binary"))).mapInArrow(lambda it: _lower(it, k), "chunk long, kth binary")
    kth = written(lower.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lambda it: _merged(it, k), "chunk long, kth binary"), "kth")
    return scan(blocks.join(kth, "chunk")).mapInArrow(_open, CANDIDATES)


def top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """For each vector whose vec_id is divisible by EVERY, its ``k`` highest inner products with the other rows: (query_id, rank, vec_id, score).

    Components are floor(SCALE * x). Ties go to the smaller vec_id, a null id
    last. A row of the same id is another row; each row that asks gets its own
    ranks. Vectors that are null or hold null or non-finite components take no
    part; vectors of another length than the query's aren't compared with it.
    Components and scores must fit 62-bit integers. Very long vectors make
    chunks of one row. Other columns are left out, whatever their names; an
    empty table gives no rows.

    Each block of queries meets each chunk once a scan, in one of at least as
    many slots as there are shuffle partitions; a slot sends ``k`` bounds a
    query. The table is stored and its rows numbered before all else.
    """
    chunks = approximated(vectors, k)
    by_bound = Window.partitionBy("query_row").orderBy(F.col("upper").desc(), "chunk", "place")
    open_ = written(candidates(chunks, k).withColumn("nth", F.row_number().over(by_bound)), "candidates")
    first = written(_scores(chunks, open_.where(F.col("nth") <= k)), "first")
    certain = first.groupBy("query_row").agg(F.min("score").alias("kth"))
    rest = open_.where(F.col("nth") > k).join(certain, "query_row").where(F.col("upper") >= F.col("kth"))
    found = first.unionAll(_scores(chunks, rest.select(open_.columns)))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "vec_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
