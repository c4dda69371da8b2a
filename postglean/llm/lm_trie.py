"""An n-gram language model in an Elias-Fano trie of shards, and the scores it gives.

The base is a smoothed unigram model of all training tokens. On it stand all
bigrams and trigrams of the training texts, however rare, so the trie grows with
the corpus: p(w | context) = (count + MU * p of the shorter context) / (count of
the context + MU). A shard is a whole trie of the n-grams whose first two words
fall to it by hash, about ``SHARD`` tokens each, so a frequent first word is
spread over all of them. No process holds more than one shard.

Levels of a shard are one buffer, as it is stored and mapped: words, then for
each word a pointer to its successors, these, for each bigram a pointer to what
follows it, and that. Pointers rise, and so do successors once each context's
range is raised above the one before it; both are Elias-Fano coded, with
quantised log probabilities beside them. A context's pointers give its range, a
successor is sought within.

Texts are read once, into batches of about ``RUN`` tokens. A batch sends each
shard its different n-grams there with their training counts, the shard is built
from what all batches send, and answers each from its buffer. Blocks are as many
as a shuffle has segments whose tasks read ``RUN`` tokens and whose partitions
hold ``SHARD``. Words are 64-bit hashes under a seed that gives no two words of
the corpus the same one, which is checked; the most frequent are numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_scratch, slices, text_bytes, written

#: Weight of the shorter context, in tokens; what is added to each count of the base.
MU = 2.0
ADD = 0.1
#: Log probabilities and weights are stored in steps of this, as 16 bits.
STEP = 1 / 2048
#: In place of a value: no such n-gram.
NONE = 65535
#: Tokens in one shard, about; tokens in a batch, about.
SHARD = 2_000_000
RUN = 3_000_000
#: Words that are sent as numbers of 16 bits; others as hashes. A batch proposes those of at least the share 1 / (2 * FREQUENT) in it.
FREQUENT = 65_535
END = b"\n"  # no word holds it
BLOCK = 64
_MOST = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class EliasFano:
    """A rising sequence in blocks of 64: a base, low bits packed, high bits in unary. Places of low bits rise too."""

    UNARY = 24

    def __init__(self, n: int, base: np.ndarray, bits: np.ndarray, starts: np.ndarray, unary: np.ndarray, low: np.ndarray):
        self.n, self.base, self.bits, self.starts, self.unary, self.low = n, base, bits, starts, unary.reshape(-1, self.UNARY), low

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        padded = np.concatenate([values, np.full(-n % BLOCK, values[-1] if n else 0)]).astype(np.int64).reshape(-1, BLOCK)
        base = padded[:, 0].copy()
        rest = padded - base[:, None]
        bits = np.array([max(0, int(u).bit_length() - 6) for u in rest[:, -1]], np.uint8)
        high = (rest >> bits[:, None].astype(np.int64)) + np.arange(BLOCK)
        unary = np.zeros((len(base), cls.UNARY * 8), np.uint8)
        np.put_along_axis(unary, high, 1, axis=1)
        starts = np.concatenate([[0], np.cumsum(bits.astype(np.int64) * (BLOCK // 8))])  # a block's low bits fill whole bytes
        low = np.zeros(int(starts[-1]), np.uint8)
        for b in np.unique(bits[bits > 0]):
            own = np.flatnonzero(bits == b)
            packed = np.packbits(((rest[own][:, :, None] >> np.arange(b)) & 1).astype(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
            low[starts[own][:, None] + np.arange(packed.shape[1])] = packed
        return cls(n, base, bits, starts[:-1], np.packbits(unary, axis=1, bitorder="little"), low)

    def blocks(self, which: np.ndarray) -> np.ndarray:
        """Values of whole blocks."""
        high = np.nonzero(np.unpackbits(self.unary[which], axis=1, bitorder="little"))[1].reshape(-1, BLOCK) - np.arange(BLOCK)
        out = high << self.bits[which][:, None].astype(np.int64)
        bits = self.bits[which]
        for b in np.unique(bits[bits > 0]).tolist():
            own = np.flatnonzero(bits == b)
            data = self.low[self.starts[which[own]][:, None] + np.arange(b * BLOCK // 8)]
            out[own] |= np.unpackbits(data, axis=1, bitorder="little").reshape(len(own), BLOCK, b).astype(np.int64) @ (1 << np.arange(b, dtype=np.int64))
        return out + self.base[which][:, None]

    def at(self, places: np.ndarray) -> np.ndarray:
        which, own = np.unique(places // BLOCK, return_inverse=True)
        return self.blocks(which)[own, places % BLOCK]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1: the block whose base it doesn't precede, then its successor there."""
        out = np.full(len(keys), -1, np.int64)
        block = np.searchsorted(self.base, keys, side="right") - 1
        asked = np.flatnonzero(block >= 0) if self.n else np.empty(0, np.int64)
        for a in range(0, len(asked), 1 << 16):
            own = asked[a : a + (1 << 16)]
            which, back = np.unique(block[own], return_inverse=True)
            values = self.blocks(which)
            place = (values[back] < keys[own][:, None]).sum(axis=1)
            hit = place < BLOCK
            hit[hit] = values[back[hit], place[hit]] == keys[own[hit]]
            out[own[hit]] = block[own[hit]] * BLOCK + place[hit]
        out[out >= self.n] = -1
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n], np.int64), self.base, self.bits, self.unary.ravel(), self.low]

    @classmethod
    def read(cls, parts: list[np.ndarray]) -> EliasFano:
        n, base, bits, unary, low = parts
        starts = np.concatenate([[0], np.cumsum(bits.astype(np.int64) * (BLOCK // 8))])[:-1]
        return cls(int(n[0]), base, bits, starts.astype(np.int64), unary, low)


def _quantised(x: np.ndarray) -> np.ndarray:
    """Logarithms in steps, from 16 (a count) down."""
    return np.clip(np.round((16 - x) / STEP), 0, NONE - 1).astype(np.uint16)


def _unquantised(x: np.ndarray) -> np.ndarray:
    return 16 - x * STEP


_KINDS = (np.int64, np.uint16, np.uint8, np.uint32, np.int32)


def _joined(parts: list[np.ndarray]) -> bytes:
    """Arrays in one buffer, each where it can be mapped."""
    head = np.array([len(parts), *chain.from_iterable((_KINDS.index(x.dtype), len(x)) for x in parts)], np.int64)
    return b"".join([head.tobytes(), *(x.tobytes() + bytes(-x.nbytes % 8) for x in parts)])


def _views(data) -> list[np.ndarray]:
    """The arrays of a buffer; nothing is copied."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8).reshape(-1, 2), 8 + 16 * n, []
    for kind, size in head.tolist():
        out.append(np.frombuffer(data, _KINDS[kind], size, at))
        at += -(-out[-1].nbytes // 8) * 8
    return out


_packed = lambda parts: zstandard.compress(_joined(parts), 3)
_unpacked = lambda data: _views(zstandard.decompress(data))


def _short(codes: np.ndarray) -> list[np.ndarray]:
    """Codes as 16 bits where they are numbers of frequent words; the others apart."""
    rare = (codes < 0) | (codes >= FREQUENT)
    return [np.where(rare, FREQUENT, codes).astype(np.uint16), codes[rare]]


def _long(short: np.ndarray, rare: np.ndarray) -> np.ndarray:
    out = short.astype(np.int64)
    out[short == FREQUENT] = rare
    return out


def _sizes(of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, minlength=n).astype(np.uint32)


class Level:
    """Successors of contexts: pointers to each context's range, and the raised successors, with values of each."""

    def __init__(self, width: int, starts: EliasFano, sequence: EliasFano, values: list[np.ndarray]):
        self.width, self.starts, self.sequence, self.values = width, starts, sequence, values

    @classmethod
    def of(cls, width: int, contexts: int, of: np.ndarray, successor: np.ndarray, values: list[np.ndarray]) -> Level:
        """From (context, successor) in order."""
        starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=contexts))])
        return cls(width, EliasFano.of(starts), EliasFano.of((of.astype(np.int64) << width) | successor), values)

    def find(self, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Place of each successor (``sizes`` of them for each context), or -1; contexts and successors of -1 have none."""
        out = np.full(len(successors), -1, np.int64)
        if not self.sequence.n:
            return out
        known = np.flatnonzero(contexts >= 0)
        lo, hi = self.starts.at(contexts[known]), self.starts.at(contexts[known] + 1)
        full = np.zeros(len(contexts), bool)
        full[known[lo < hi]] = True
        asked = np.flatnonzero(np.repeat(full, sizes) & (successors >= 0))
        out[asked] = self.sequence.find((np.repeat(contexts, sizes)[asked] << self.width) | successors[asked])
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.width], np.int64), *self.starts.parts(), *self.sequence.parts(), *self.values]

    @classmethod
    def read(cls, parts: list[np.ndarray], values: int) -> Level:
        return cls(int(parts[0][0]), EliasFano.read(parts[1:6]), EliasFano.read(parts[6:11]), parts[11 : 11 + values])


class Trie:
    """One shard: its words, the bigrams behind each, the trigrams behind these."""

    def __init__(self, words: np.ndarray, two: Level, three: Level):
        self.words, self.two, self.three = words, two, three

    @classmethod
    def of(cls, first: np.ndarray, second: np.ndarray, n2: np.ndarray, of: np.ndarray, third: np.ndarray, n3: np.ndarray) -> Trie:
        """From bigrams (codes, counts) and trigrams (of which bigram, code, count), in any order and repeated; what was never seen in training is left out."""
        words, ids = np.unique(np.concatenate([first, second, third]), return_inverse=True)
        ids = ids.reshape(-1)
        first, second, third = np.split(ids, [len(first), 2 * len(first)])
        width = max(1, int(len(words)).bit_length())
        pairs, back = np.unique((first << width) | second, return_inverse=True)
        n2 = np.bincount(back.reshape(-1), n2, len(pairs)).astype(np.int64)
        kept = n2 > 0
        place = np.cumsum(kept) - 1
        own = kept[back.reshape(-1)[of]] & (n3 > 0)
        triples, again = np.unique((place[back.reshape(-1)[of[own]]] << width) | third[own], return_inverse=True)
        n3 = np.bincount(again.reshape(-1), n3[own], len(triples)).astype(np.int64)
        pairs, n2 = pairs[kept], n2[kept]
        low = (1 << width) - 1
        with np.errstate(divide="ignore"):
            two = Level.of(width, len(words), pairs >> width, pairs & low, [_quantised(np.log10(n2)), _quantised(np.log10(MU / (n2 + MU)))])
            three = Level.of(width, len(pairs), triples >> width, triples & low, [_quantised(np.log10(n3 / (n2[triples >> width] + MU)))])
        return cls(words, two, three)

    def save(self) -> bytes:
        return _joined([self.words, *self.two.parts(), *self.three.parts()])

    @classmethod
    def load(cls, data) -> Trie:
        """Views of a buffer, which may be a mapped file's."""
        parts = _views(data)
        return cls(parts[0], Level.read(parts[1:14], 2), Level.read(parts[14:], 1))

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(codes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return np.where(self.words[at] == codes, at, -1)

    def answer(self, first: np.ndarray, seconds: np.ndarray, second: np.ndarray, thirds: np.ndarray, third: np.ndarray) -> list[np.ndarray]:
        """Values of bigrams (count, weight of what is shorter) and of trigrams (probability): each first word has ``seconds`` bigrams, each of these ``thirds`` trigrams."""
        places = self.two.find(self._ids(first), seconds, self._ids(second))
        deeper = self.three.find(places, thirds, self._ids(third))
        taken = lambda values, at: np.where(at >= 0, values[np.maximum(at, 0)], NONE).astype(np.uint16) if len(values) else np.full(len(at), NONE, np.uint16)
        return [*(taken(v, places) for v in self.two.values), taken(self.three.values[0], deeper)]


def _tokens(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Tokens of all texts, each with its end, and the number of each text's."""
    split = [[*x.as_py().lower().split(), END] for x in column]
    return list(chain.from_iterable(split)), np.array([len(s) for s in split])


class _Hashes(dict):
    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return out


BATCH = "batch long, doc_id array<long>, held_out array<boolean>, words binary, checks binary, ids binary, ends binary, counts binary, proposed binary"


def _batched(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Batches of about RUN tokens: ids and flags of their texts, their different words' hashes, most frequent first, 16 other bits of each, tokens as places among these, ends of texts, the words' training counts, the counts of frequent ones."""
    from pyspark import TaskContext

    number, held, n, hashes = TaskContext.get().partitionId() << 32, [], 0, _Hashes(seed)

    def flush() -> pa.RecordBatch:
        nonlocal number, n
        words, first, ids, times = np.unique(np.concatenate([h for h, *_ in held]), return_index=True, return_inverse=True, return_counts=True)
        by = np.argsort(-times, kind="stable")
        words, first, times, ids = words[by], first[by], times[by], np.argsort(by)[ids.reshape(-1)]
        checks = np.concatenate([c for _, c, *_ in held])[first]
        ends = np.cumsum(np.concatenate([k for *_, k, _ in held])).astype(np.int64)
        docs = {c: list(chain.from_iterable(d[c].to_pylist() for *_, d in held)) for c in ("doc_id", "held_out")}
        training = ~np.repeat(np.array(docs["held_out"], bool), np.diff(np.concatenate([[0], ends])))
        counts = np.bincount(ids[training], minlength=len(words)).astype(np.uint32)
        binary = (words, checks, ids.astype(np.int32), ends, counts, times[times * 2 * FREQUENT >= len(ids)])
        out = [pa.array([number]), pa.array([docs["doc_id"]], pa.list_(pa.int64())), pa.array([docs["held_out"]], pa.list_(pa.bool_())), *(pa.array([x.tobytes()], pa.binary()) for x in binary)]
        number, n = number + 1, 0
        held.clear()
        return pa.RecordBatch.from_arrays(out, ["batch", "doc_id", "held_out", "words", "checks", "ids", "ends", "counts", "proposed"])

    for batch in slices(batches):
        if batch.num_rows:
            tokens, sizes = _tokens(batch["bytes"])
            h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens)).view(np.int64)
            _, first = np.unique(h, return_index=True)
            checks = np.zeros(len(h), np.uint16)
            checks[first] = [xxhash.xxh32_intdigest(tokens[k]) & 0xFFFF for k in first.tolist()]
            held.append((h, checks, sizes, batch.select(["doc_id", "held_out"])))
            n += len(h)
            if n >= RUN:
                yield flush()
    if held:
        yield flush()


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent words with their counts in a batch; the batch's tokens as word 0."""
    for batch in batches:
        for words, times, ends in zip(*(batch[c] for c in ("words", "proposed", "ends"))):
            words, times, ends = (np.frombuffer(x.as_py(), np.int64) for x in (words, times, ends))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(words[: len(times)], 0)), pa.array(np.append(times, ends[-1] if len(ends) else 0))], ["item", "n"])


class _Grams:
    """The n-grams of one batch: its words' codes, different bigrams and trigrams in the order of shards, and which of them ends at each token."""

    def __init__(self, columns: dict, frequent: np.ndarray, n_shards: int):
        words, ids, ends = (np.frombuffer(columns[c], kind) for c, kind in (("words", np.int64), ("ids", np.int32), ("ends", np.int64)))
        self.sizes = np.diff(np.concatenate([[0], ends]))
        self.ends, self.ids = ends, ids
        training = ~np.repeat(np.array(columns["held_out"], bool), self.sizes)
        codes = words.copy()
        if len(frequent):  # hashes in order, with their numbers
            at = np.minimum(np.searchsorted(frequent[0], words), frequent.shape[1] - 1)
            codes = np.where(frequent[0][at] == words, frequent[1][at], words)
        by = np.argsort(codes.view(np.uint64), kind="stable")  # numbers come first, so n-grams of a shard come by code
        place = np.argsort(by)
        self.codes, n = codes[by], len(codes)
        if "counts" in columns:
            self.counts, self.checks = (np.frombuffer(columns[c], kind)[by] for c, kind in (("counts", np.uint32), ("checks", np.uint16)))
        of_shard = _mix(self.codes.view(np.uint64)) % np.uint64(n_shards)
        self.words, self.word_shard = np.argsort(of_shard, kind="stable"), np.sort(of_shard).astype(np.int64)
        tokens = place[ids]
        opens = np.zeros(len(tokens) + 1, bool)
        opens[np.concatenate([[0], ends]).astype(np.int64)] = True
        at2 = np.flatnonzero(~opens[: len(tokens)])
        self.at = [at2, at2[~opens[at2 - 1]]]
        pairs, back = np.unique(tokens[at2 - 1] * n + tokens[at2], return_inverse=True)
        first, second = np.divmod(pairs, max(1, n))
        shard = (_mix(_mix(self.codes[first].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + self.codes[second].view(np.uint64)) % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.argsort(order)
        self.first, self.second, self.shard = first[order], second[order], shard[order]
        self.two = rank[back.reshape(-1)]
        self.n2 = np.bincount(self.two, training[at2], len(pairs)).astype(np.uint32)
        of = np.zeros(len(tokens), np.int64)
        of[at2] = self.two
        triples, self.three = np.unique(of[self.at[1] - 1] * n + tokens[self.at[1]], return_inverse=True)
        self.three = self.three.reshape(-1)
        self.of, self.third = np.divmod(triples, max(1, n))
        self.n3 = np.bincount(self.three, training[self.at[1]], len(triples)).astype(np.uint32)
        self.tokens = tokens

    def shards(self) -> Iterator[tuple[int, slice, slice, slice]]:
        """Each shard that is asked, with its words, bigrams and trigrams."""
        asked = np.unique(np.concatenate([self.shard, self.word_shard]))
        cut = lambda x: np.searchsorted(x, np.append(asked, asked[-1:] + 1))
        words, two = cut(self.word_shard), cut(self.shard)
        three = np.searchsorted(self.of, two)
        for k, shard in enumerate(asked.tolist()):
            yield shard, *(slice(int(x[k]), int(x[k + 1])) for x in (words, two, three))

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """What each shard is asked: words, their other bits and counts; first words, how many bigrams each has, second words, counts, how many trigrams each has, third words, counts."""
        for shard, words, two, three in self.shards():
            first, own = self.first[two], self.words[words]
            new = np.flatnonzero(np.diff(first, prepend=-1))
            seconds = np.diff(np.append(new, len(first))).astype(np.uint32)
            thirds = _sizes(self.of[three] - two.start, two.stop - two.start)
            grams = [*_short(self.codes[first[new]]), seconds, *_short(self.codes[self.second[two]]), self.n2[two], thirds, *_short(self.codes[self.third[three]]), self.n3[three]]
            yield shard, _packed([*_short(self.codes[own]), self.checks[own], self.counts[own], *grams])


_READ = ["held_out", "words", "ids", "ends"]
_TOLD = ["checks", "counts"]


def _asked(batches: Iterator[pa.RecordBatch], frequent, n_shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            for shard, data in _Grams({c: batch[c][k].as_py() for c in _READ + _TOLD}, frequent.value, n_shards).blocks():
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), batch["batch"].slice(k, 1), pa.array([data], pa.binary())], ["shard", "batch", "data"])


def _block(data: bytes) -> list[np.ndarray]:
    """(first, seconds, second, n2, thirds, third, n3, words, counts, checks) of a block."""
    v, w, checks, counts, a, b, seconds, c, d, n2, thirds, e, f, n3 = _unpacked(data)
    return [_long(a, b), seconds, _long(c, d), n2, thirds, _long(e, f), n3, _long(v, w), counts, checks]


def _words(blocks: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of a shard with their training counts, and how many are two words of one hash."""
    items, counts, checks = (np.concatenate([x[j] for x in blocks]) for j in (7, 8, 9))
    words, first, back = np.unique(items, return_index=True, return_inverse=True)
    odd = checks != checks[first][back.reshape(-1)]
    return words, np.bincount(back.reshape(-1), counts, len(words)).astype(np.int64), int(odd.sum())


class _Merged:
    """What all batches ask of a shard: different bigrams and trigrams in order with their training counts, and which of them each batch's are."""

    def __init__(self, blocks: list[list[np.ndarray]]):
        first = np.concatenate([np.repeat(x[0], x[1]) for x in blocks])
        second, n2, third, n3 = (np.concatenate([x[j] for x in blocks]) for j in (2, 3, 5, 6))
        of = np.repeat(np.arange(len(second)), np.concatenate([x[4] for x in blocks]))
        words, ids = np.unique(np.concatenate([first, second, third]), return_inverse=True)
        ids, n = ids.reshape(-1), max(1, len(words))
        pairs, self.two = np.unique(ids[: len(first)] * n + ids[len(first) : 2 * len(first)], return_inverse=True)
        self.two = self.two.reshape(-1)
        triples, self.three = np.unique(self.two[of] * n + ids[2 * len(first) :], return_inverse=True)
        self.three = self.three.reshape(-1)
        self.n2, self.n3 = (np.bincount(x, w, len(y)).astype(np.int64) for x, w, y in ((self.two, n2, pairs), (self.three, n3, triples)))
        self.first, self.second = words[pairs // n], words[pairs % n]
        self.of, self.third = triples // n, words[triples % n]
        self.ends2, self.ends3 = (np.cumsum([len(x[j]) for x in blocks]) for j in (2, 5))

    def trie(self) -> Trie:
        return Trie.of(self.first, self.second, self.n2, self.of, self.third, self.n3)

    def answers(self, trie: Trie) -> Iterator[list[np.ndarray]]:
        """Each batch's values in its order: every different n-gram is sought once."""
        new = np.flatnonzero(np.append(True, self.first[1:] != self.first[:-1])) if len(self.first) else np.empty(0, np.int64)
        count, weight, direct = trie.answer(self.first[new], np.diff(np.append(new, len(self.first))), self.second, _sizes(self.of, len(self.first)), self.third)
        for a, b, c, d in zip(np.append(0, self.ends2), self.ends2, np.append(0, self.ends3), self.ends3):
            two, three = self.two[a:b], self.three[c:d]
            yield [count[two], weight[two], direct[three]]


SERVED = "shard long, batch long, answer binary, total long, distinct long, clash long"
SERVED_NAMES = ["shard", "batch", "answer", "total", "distinct", "clash"]


def _served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (shard, batch): each shard is built from what all batches send of it, laid out in its buffer, and answers each of them from there."""
    held: list[tuple[int, list[np.ndarray]]] = []
    shard = None

    def done() -> Iterator[pa.RecordBatch]:
        merged = _Merged([x for _, x in held])
        trie = Trie.load(merged.trie().save())
        words, counts, clash = _words([x for _, x in held])
        row = lambda number, answer, *figures: pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number]), pa.array([answer], pa.binary()), *(pa.array([f], pa.int64()) for f in figures)], SERVED_NAMES)
        yield row(-1, None, int(counts.sum()), int((counts > 0).sum()), clash)
        told = counts.astype(np.uint32) if counts.max(initial=0) < 2**32 else counts
        for (number, (*_, own, _, _)), values in zip(held, merged.answers(trie)):
            yield row(number, _packed([told[np.searchsorted(words, own)], *values]), None, None, None)
        held.clear()

    for batch in batches:
        for own, number, data in zip(batch["shard"].to_pylist(), batch["batch"].to_pylist(), batch["data"]):
            if held and own != shard:
                yield from done()
            shard = own
            held.append((number, _block(data.as_py())))
    if held:
        yield from done()


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard: each shard's buffer."""
    held: list = []
    shard = None

    def row() -> pa.RecordBatch:
        if _words(held)[2]:
            raise ValueError("two words have one hash: build with another seed")
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([_Merged(held).trie().save()], pa.binary())], ["shard", "trie"])

    for batch in batches:
        for own, data in zip(batch["shard"].to_pylist(), batch["data"]):
            if held and own != shard:
                yield row()
                held.clear()
            shard = own
            held.append(_block(data.as_py()))
    if held:
        yield row()


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(batches: Iterator[pa.RecordBatch], frequent, n_shards: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Rows by (batch, shard): the batch itself as shard -1, then its answers."""
    held, answers, docs = None, {}, []

    def done() -> pa.RecordBatch:
        grams, counts = held, np.zeros(len(held.codes), np.int64)
        found = [np.full(len(grams.second), NONE, np.uint16), np.full(len(grams.second), NONE, np.uint16), np.full(len(grams.third), NONE, np.uint16)]
        for shard, words, two, three in grams.shards():
            n, *values = _unpacked(answers[shard])
            counts[grams.words[words]] = n
            for out, where, data in zip(found, (two, two, three), values):
                out[where] = data
        own = counts[grams.tokens]
        base = np.log10(own + ADD) - scale
        p = 10.0**base
        at2, at3 = grams.at
        n2 = np.where(found[0] == NONE, 0.0, 10.0 ** _unquantised(found[0].astype(np.float64)))[grams.two]
        p[at2] = (n2 + MU * p[at2]) / (own[at2 - 1] + MU)
        place = np.zeros(len(p), np.int64)
        place[at2] = grams.two
        context = place[at3 - 1]
        weight = np.where(found[1][context] == NONE, 1.0, 10.0 ** _unquantised(found[1][context].astype(np.float64)))
        direct = np.where(found[2] == NONE, 0.0, 10.0 ** _unquantised(found[2].astype(np.float64)))[grams.three]
        p[at3] = direct + weight * p[at3]
        starts = grams.ends - grams.sizes
        per = lambda x: pa.array(np.add.reduceat(x, starts))
        out = pa.RecordBatch.from_arrays([*docs, pa.array(grams.sizes), per((own > 0).astype(np.int64)), per(base), per(np.log10(p))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        answers.clear()
        return out

    for batch in batches:
        for k in range(batch.num_rows):
            if batch["shard"][k].as_py() >= 0:
                answers[batch["shard"][k].as_py()] = batch["answer"][k].as_py()
            else:
                if held:
                    yield done()
                    held = None  # not two batches at a time
                held = _Grams({c: batch[c][k].as_py() for c in _READ}, frequent.value, n_shards)
                docs = [pa.array(batch[c][k].as_py(), kind) for c, kind in (("doc_id", pa.int64()), ("held_out", pa.bool_()))]
    if held:
        yield done()


def _prepared(docs: DataFrame, seed: int) -> tuple[DataFrame, object, int]:
    """Stored batches of the texts, the frequent words (hashes in order, numbers), the number of shards."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    texts = docs.select("doc_id", held.alias("held_out"), text_bytes().alias("bytes"))
    batches = written(texts.mapInArrow(lambda it: _batched(it, seed), BATCH), "batches")
    found = batches.select("words", "proposed", "ends").mapInArrow(_proposed, "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))
    # no more than FREQUENT rows, word 0 besides; a word that looks like a number stays a hash
    top = found.where((F.col("item") < 0) | (F.col("item") >= FREQUENT) | (F.col("item") == 0)).orderBy(F.col("item") != 0, F.col("n").desc(), "item").limit(FREQUENT).collect()
    tokens = sum(r.n for r in top if not r.item)
    items = np.array([r.item for r in top if r.item], np.int64)
    by = np.argsort(items)
    frequent = spark.sparkContext.broadcast(np.stack([items[by], by]) if len(items) else np.empty((0, 0), np.int64))
    return batches, frequent, max(1, -(-tokens // SHARD))


def _dealt(batches: DataFrame, frequent, n_shards: int) -> DataFrame:
    """What batches ask, by shard."""
    asked = batches.select("batch", *_READ, *_TOLD).mapInArrow(lambda it: _asked(it, frequent, n_shards), "shard long, batch long, data binary")
    return asked.repartition("shard").sortWithinPartitions("shard", "batch")


def trie(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, trie): the model of the training texts of ``docs`` (doc_id, text), a buffer a shard that ``Trie.load`` maps."""
    return _dealt(*_prepared(docs, seed)).mapInArrow(_stored, "shard long, trie binary")


def score(docs: DataFrame) -> DataFrame:
    """Scores each text of ``docs`` (doc_id, text) by a model of those whose crc32(doc_id as text) mod 10 isn't 0.

    Returns doc_id, held_out, n_tokens (words and an end), n_known (tokens with
    a training count), train_tokens, base_score and score (log10 probabilities
    by the unigram base and by the model). Null texts are empty: an end alone. A
    null id counts as empty text and so is held out. Repeated rows are scored
    each, alike. A very long text is one batch. Other columns are left out,
    whatever their names; an empty table gives no rows.
    """
    for seed in count():
        batches, frequent, n_shards = _prepared(docs, seed)
        served = written(_dealt(batches, frequent, n_shards).mapInArrow(_served, SERVED), "served")
        total, distinct, clash = served.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "clash")]).first()
        clear_scratch(docs.sparkSession, [])  # what batches have sent isn't asked for any more
        if not clash:  # else two words have one hash: another seed
            break
    scale = math.log10(total + ADD * (distinct + 1)) if total else math.log10(ADD)
    answers = served.where("batch >= 0").select("shard", "batch", "answer")
    both = batches.select("batch", "doc_id", *_READ, F.lit(-1).cast("long").alias("shard")).unionByName(answers, allowMissingColumns=True)
    both = both.repartition("batch").sortWithinPartitions("batch", "shard")
    out = both.mapInArrow(lambda it: _scored(it, frequent, n_shards, scale), SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
