"""Document fingerprints by I-Match with randomised lexicons.

Terms that occur in a middling share of the other documents form the lexicon.
Each of ``SUBSETS`` fixed random subsets of it gives one signature of a text: the
hash of the text's distinct terms in that subset, sorted. Subsets differ in
size, so that short texts and long ones both have signatures that survive
edits, and so that the share of equal ones falls as texts have less in common.
One signature more is that of all terms, in the band or not: it alone tells
texts without terms of the band apart. One rule signs all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Band of inverse document frequency, as shares of all documents that hold a term. The lower share bounds the
#: lexicon: it has at most (mean distinct terms of a document) / RAREST terms, however many documents there are.
RAREST, COMMONEST = 1 / 2000, 1 / 4
#: How many subsets there are of a quarter of the terms, of an eighth, and so on. Most are small: they tell how much two texts share.
SIZES = (4, 4, 4, 8, 16, 20, 20, 20)
SUBSETS = sum(SIZES)
RATES = np.repeat(2.0 ** -np.arange(2, 2 + len(SIZES)), SIZES)
LONGEST_TERM = 64
_FLUSH = 500_000

#: ASCII letters in lower case; ASCII marks and control characters as spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_NONE = "-" * 8


def terms(text: bytes) -> set[bytes]:
    """Distinct terms of a text; an overlong one by its digest."""
    found = set(text.translate(_PLAIN).split())
    return {t if len(t) <= LONGEST_TERM else sha256(t).digest() for t in found} if len(text) > LONGEST_TERM else found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def members(keys: np.ndarray) -> np.ndarray:
    """Which subsets each term is in: one row a subset."""
    seeds = (np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    return (_mixed(keys[None, :] + seeds) >> np.uint64(11)) < RATES[:, None] * 2.0**53


def _key(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


class Lexicon:
    """Terms of the band in order, and their subsets."""

    def __init__(self, found: list[bytes]):
        found = sorted(found)
        self.keys = np.array([_key(t) for t in found], np.uint64)
        self.place = {t: k for k, t in enumerate(found)}
        self.members = members(self.keys)

    def fingerprint(self, text: bytes) -> str:
        """Signatures of 8 hex digits: that of all terms, then one a subset; a subset that has no term of the text gives dashes."""
        own = terms(text)
        places = np.sort(np.fromiter((self.place[t] for t in self.place.keys() & own), np.int64))
        keys, inside = self.keys[places], self.members[:, places]
        whole = xxhash.xxh3_64_intdigest(b" ".join(sorted(own)))
        return "".join([f"{whole >> 32:08x}", *(f"{xxhash.xxh3_64_intdigest(keys[row].tobytes()) >> 32:08x}" if row.any() else _NONE for row in inside)])


def likeness(a: str, b: str) -> float:
    """Share of equal signatures among those that either text has; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    pairs = [(a[k : k + 8], b[k : k + 8]) for k in range(0, len(a), 8)]
    either = [x == y for x, y in pairs if x != _NONE or y != _NONE]
    return sum(either) / len(either)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["term", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch["bytes"]:
            seen.update(terms(text.as_py()))
            if len(seen) >= _FLUSH:
                yield rows()
    yield rows()


def build_lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> Lexicon:
    """Counts the documents of every term, over all documents; tasks send partial counts. Only the band reaches the driver."""
    texts = docs.select(text_bytes().alias("bytes"))
    n = texts.count()  # of the other documents a term may be in COMMONEST at most, so tables of any size have a band
    counts = texts.mapInArrow(_counted, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= rarest * n) & (F.col("n") - 1 <= commonest * (n - 1))).select("term")
    return Lexicon(band.toArrow()["term"].to_pylist())


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _signed(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    """Rows by (bucket, extra, id): each with the next. An extra row is the next of its bucket's last."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    sign = lexicon.value.fingerprint
    open_ = None
    for batch in batches:
        out: list[tuple] = []
        for doc_id, data, bucket, extra in zip(batch["doc_id"].to_pylist(), batch["bytes"], batch["bucket"].to_pylist(), batch["extra"].to_pylist()):
            if extra and open_ is None:
                continue  # one of several equal rows, all extra; the first has served
            data = data.as_py()
            text, own = data.decode(), sign(data)
            if open_ is not None and open_[0] == bucket:
                _, last_id, last, last_sign = open_
                edited = _edited(last, text).encode()
                edited_sign = sign(edited)
                out.append((last_id, len(last), sha256(edited).hexdigest(), last_sign, edited_sign, likeness(last_sign, edited_sign), likeness(last_sign, own)))
            open_ = None if extra else (bucket, doc_id, text, own)
        columns = zip(*out) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def fingerprints(docs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text) and of its edited text, and how alike they are.

    The edited text has its last half replaced by as much of the next document,
    by ascending doc_id (null ids first, rows of one id by their text's hash),
    the first after the last; a single document is its own next. Null texts are
    empty; a text without terms of the band has the signature of all its terms
    and dashes. Equal texts have equal fingerprints; repeated rows follow each
    other. Very long texts are signed whole; a text and its next must fit in a
    task. An empty table gives no rows; other columns are left out, whatever
    their names.

    Texts are shuffled once, into ranges of (id, hash). The bounds are rows of
    the table: such a row is also sent to the range before its own.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon or build_lexicon(docs))
    rows = docs.select("doc_id", text_bytes().alias("bytes"))
    rows = rows.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.xxhash64("bytes").alias("c")))
    least, n = rows.agg(F.min("key"), F.count("*")).first()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = [r.key for r in rows.select("key").sample(min(1.0, 40 * ranges / max(n, 1)), 7).collect()]
    sample.sort()
    bounds = sorted({tuple(x) for x in [*([least] if least else []), *sample[:: max(1, len(sample) // ranges)]]})
    edge = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abc", b)]) for b in bounds]) if bounds else F.array(F.col("key"))
    rows = rows.withColumn("bucket", F.size(F.filter(edge, lambda b: b <= F.col("key"))))
    head = F.element_at(edge, F.greatest("bucket", F.lit(1))) == F.col("key")
    before = F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(F.lit(len(bounds)))
    places = F.when(head, F.array(F.struct(F.col("bucket"), F.lit(0).alias("extra")), F.struct(before.alias("bucket"), F.lit(1).alias("extra"))))
    rows = rows.select("doc_id", "bytes", "key", F.inline(F.coalesce(places, F.array(F.struct(F.col("bucket"), F.lit(0).alias("extra"))))))
    dealt = rows.repartitionByRange(ranges, "bucket").sortWithinPartitions("bucket", "extra", "key").select("doc_id", "bytes", "bucket", "extra")
    return dealt.mapInArrow(lambda it: _signed(it, shared), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
