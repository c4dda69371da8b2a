"""Token-ID output in Simple-8b blocks.

A block holds ids of whole or part documents as 64-bit words: the top 4 bits
select how many values of how many bits the other 60 hold. Where a slot is too
narrow for a value, it holds its all-ones mark and the value follows in the
block's escapes, in order. Each block carries the counts that place it, so any
block is decoded alone, selector by selector, without a loop over values.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_bytes, written
from .tokens import Encoder, default_tokenizer

#: Values to a word, widest words last; the bits of each are 60 divided by it.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // n for n in COUNTS)
#: Escapes allowed in a word: they pay where they make room for several more values.
ESCAPES = tuple(1 if 5 <= n <= 12 else 0 for n in COUNTS)
#: Ids in a block, about; a longer document spans several.
BLOCK_IDS = 65_536
END_ID = 2

FILE_SCHEMA = "file int, block int, first_id long, n_ids long, words binary, escapes binary, docs binary"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of ``values`` (0 to 2**63 - 1). A word with too few values left for its selector is filled with zeros."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    take = np.full(n, len(COUNTS) - 1, np.uint8)  # of the word that starts here: the selector
    open_ = np.ones(n, bool)
    top = int(values.max())
    narrow = values.astype(np.uint32) if top < 1 << 32 else values
    wide = np.zeros(n + 1 + COUNTS[0], np.int32)
    for s, (count, bits, spare) in enumerate(zip(COUNTS, BITS, ESCAPES)):
        if top < (1 << bits) - 1:  # all the rest fit
            take[open_] = s
            break
        np.cumsum(narrow >= (1 << bits) - 1, dtype=np.int32, out=wide[1 : n + 1])
        wide[n + 1 :] = wide[n]
        fits = open_ & (wide[count : count + n] - wide[:n] <= spare)
        take[fits] = s
        open_ ^= fits
    steps = np.array(COUNTS)[take].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    chosen = take[starts]
    words, marked = np.zeros(len(starts), np.uint64), np.zeros(n, bool)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for s in np.unique(chosen):
        count, bits = COUNTS[s], BITS[s]
        own, top = np.flatnonzero(chosen == s), np.uint64((1 << bits) - 1)
        at, word = starts[own], np.full(len(own), np.uint64(int(s) << 60))
        for k in range(count):
            slot = padded[at + k]
            if ESCAPES[s] or count == 1:  # the widest word takes any value
                marked[at[slot >= top] + k] = True
                slot = np.minimum(slot, top)
            word |= slot << np.uint64(k * bits)
        words[own] = word
    return words, values[marked]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block: all words of a selector at once, then the escapes in order."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(np.array(COUNTS)[selectors]) if len(words) else np.empty(0, np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    marked = np.zeros(len(out), bool)
    for s in np.unique(selectors):
        count, bits = COUNTS[s], BITS[s]
        own, top = np.flatnonzero(selectors == s), np.uint64((1 << bits) - 1)
        at = (ends[own] - count)[:, None] + np.arange(count)
        slots = (words[own][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & top
        out[at], marked[at] = slots, slots == top
    out, marked = out[:n], marked[:n]
    out[marked] = escapes
    return out


def _blocks(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """File rows of one partition. docs: for each document that starts or goes on here, its id, whether the id is null, its ids in this block, and whether it ends here."""
    from pyspark import TaskContext

    file, encoder = TaskContext.get().partitionId(), Encoder.of(tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    parts: list[bytes] = []
    docs: list[tuple[int, int, int, int]] = []
    held = block = first = 0

    def row() -> pa.RecordBatch:
        words, escapes = encode(np.frombuffer(b"".join(parts), "<u4"))
        return pa.RecordBatch.from_pydict({
            "file": pa.array([file], pa.int32()), "block": pa.array([block], pa.int32()), "first_id": [first], "n_ids": [held],
            "words": [words.astype("<u8").tobytes()], "escapes": [escapes.astype("<u8").tobytes()], "docs": [np.array(docs, "<i8").tobytes()],
        })

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["bytes"]):
            ids = encoder.ids(text.as_py().decode()) + end
            while ids:
                part = ids[: 4 * (BLOCK_IDS - held)]
                ids = ids[len(part) :]
                parts.append(part)
                docs.append((doc_id or 0, doc_id is None, len(part) // 4, not ids))
                held += len(part) // 4
                if held == BLOCK_IDS:
                    yield row()
                    block, first, held, parts, docs = block + 1, first + held, 0, [], []
    if held:
        yield row()


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of ``docs`` (doc_id, text) as files of blocks under ``path``, in ascending doc_id order.

    Order: null ids first, rows of one id by their text's hash, so reruns
    agree. Null and empty texts are their end id alone; an empty table gives a
    folder without rows. Rows that repeat are each written. Very long texts are
    encoded whole and run over as many blocks as they need. Other columns are
    left out, whatever their names. Texts move once, by range of id; rows of one
    hot id are dealt by hash too.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", text_bytes().alias("bytes")).withColumn("tie", F.xxhash64("bytes"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ranged.mapInArrow(lambda it: _blocks(it, tokenizer, end_id), FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents by block, decoded: (doc_id, file, at, n_ids, ends, ids)."""
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u8"), r["n_ids"]).astype("<u4")
            docs = np.frombuffer(r["docs"], "<i8").reshape(-1, 4)
            at = np.concatenate([[0], np.cumsum(docs[:, 2])])
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(docs[:, 0], pa.int64(), mask=docs[:, 1] == 1), "file": pa.array(np.full(len(docs), r["file"]), pa.int32()),
                "at": r["first_id"] + at[:-1], "n_ids": docs[:, 2], "ends": docs[:, 3] == 1,
                "ids": pa.array([ids[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
            })


def read_token_files(spark, path: str) -> DataFrame:
    """The stored documents in pieces: (doc_id, file, at, n_ids, ends, ids); ``at`` counts the ids before it in its file."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(_documents, "doc_id long, file int, at long, n_ids long, ends boolean, ids binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document from the blocks of a file in order; a document that goes on in the next block keeps its running crc."""
    file, crc, count, start = None, 0, 0, 0
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "file": [], "at": [], "n_tokens": [], "ids_crc32": []}
        for r in batch.to_pylist():
            if r["file"] != file:
                file, crc, count = r["file"], 0, 0
            ids = decode(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u8"), r["n_ids"]).astype("<u4").tobytes()
            at = 0
            for doc_id, null, n, ends in np.frombuffer(r["docs"], "<i8").reshape(-1, 4).tolist():
                start = start if count else r["first_id"] + at
                crc, count = zlib.crc32(ids[4 * at : 4 * (at + n)], crc), count + n
                at += n
                if ends:
                    for k, v in zip(out, (None if null else doc_id, file, start, count, crc)):
                        out[k].append(v)
                    crc = count = 0
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "file" else pa.int64()) for k, v in out.items()], list(out))


def token_digests(spark, path: str) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files.

    A file is one range of ids, so its blocks are put in order within one task
    each; the ids before a file are a running sum over one row a file.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = blocks.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_digests, "doc_id long, file int, at long, n_tokens long, ids_crc32 long")
    return found.join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame) -> DataFrame:
    """Writes the files to the shared folder and gives what they hold."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path)
    return token_digests(spark, path)
