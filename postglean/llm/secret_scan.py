"""Secrets in texts by one deterministic automaton of all rules.

Each rule is a regular expression over bytes. The reversed rules become one
nondeterministic automaton, by subset construction one deterministic one, and
that by partition refinement the least one, kept as an array of transitions by
state and class of bytes. Read from a text's end to its begin, it tells at each
byte which rules have a match that starts there: one pass for all rules. From
the first start of a rule that no earlier match of it covers, the rule's own
small automaton finds the longest match.

Bytes that take every state to the same one cut a text into lanes that don't
know of each other, so thousands of lanes are read in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Bytes of text that are read in step, about; bytes of a lane, about; with fewer lanes than this each is read by itself.
RUN = 1 << 22
LANE = 1024
FEW = 24


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, its least length, and the least number of its characters from where it is first complete."""

    kind: str
    pattern: str
    least: int = 1
    tail: int = 1


#: The base kinds come first, as their order is that of equal starts.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", tail=6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Public forms of keys, and credentials in addresses.
MORE = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("address", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+,;=-]+@"),
)
RULES = BASE + MORE


class _Pattern:
    """A regular expression as a tree: ("set", bytes), ("all", parts), ("any", parts), ("times", part, least, most or None)."""

    def __init__(self, source: str):
        self.rest = source
        self.tree = self._any()
        if self.rest:
            raise ValueError(f"unread: {self.rest}")

    def _take(self, n: int = 1) -> str:
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def _any(self):
        parts = [self._all()]
        while self.rest[:1] == "|":
            self._take()
            parts.append(self._all())
        return ("any", parts) if len(parts) > 1 else parts[0]

    def _all(self):
        parts = []
        while self.rest and self.rest[0] not in "|)":
            parts.append(self._times(self._one()))
        return ("all", parts)

    def _times(self, part):
        mark = self.rest[:1]
        if mark and mark in "?*+":
            self._take()
            return ("times", part, int(mark == "+"), 1 if mark == "?" else None)
        if mark == "{":
            inner, self.rest = self.rest[1:].split("}", 1)
            least, comma, most = inner.partition(",")
            return ("times", part, int(least), int(most) if most else None if comma else int(least))
        return part

    def _one(self):
        c = self._take()
        if c == "(":
            out = self._any()
            if self._take() != ")":
                raise ValueError("group isn't closed")
            return out
        if c == "[":
            found: set[int] = set()
            while self.rest[:1] != "]":
                a = self._byte(self._take())
                b = a
                if self.rest[:1] == "-" and self.rest[1:2] != "]":
                    self._take()
                    b = self._byte(self._take())
                found.update(range(a, b + 1))
            self._take()
            return ("set", frozenset(found))
        return ("set", frozenset([self._byte(c)]))

    def _byte(self, c: str) -> int:
        if c == "\\":
            c = self._take()
            if c == "x":
                return int(self._take(2), 16)
        if not c or ord(c) > 127:
            raise ValueError("patterns are of ASCII characters")
        return ord(c)


def _reversed(tree):
    if tree[0] == "set":
        return tree
    if tree[0] == "times":
        return ("times", _reversed(tree[1]), *tree[2:])
    parts = [_reversed(x) for x in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "all" else parts)


class _Nfa:
    """Steps by bytes and free steps between states."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.steps: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.steps.append(None)
        return len(self.free) - 1

    def add(self, tree, begin: int) -> int:
        """The state that ``tree`` leads to from ``begin``."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            middle = self.state()
            self.free[begin].append(middle)
            self.steps[middle] = (tree[1], end)
            return end
        if kind == "all":
            for part in tree[1]:
                begin = self.add(part, begin)
            return begin
        end = self.state()
        if kind == "any":
            for part in tree[1]:
                self.free[self.add(part, begin)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            begin = self.add(part, begin)
        if most is None:
            loop = self.state()
            self.free[begin].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[begin].append(end)
            for _ in range(most - least):
                begin = self.add(part, begin)
                self.free[begin].append(end)
        return end

    def closed(self, states) -> frozenset:
        seen, left = set(states), list(states)
        while left:
            for x in self.free[left.pop()]:
                if x not in seen:
                    seen.add(x)
                    left.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """States by number, those that accept first: ``step[state, class_of[byte]]``, and the rules (a bit each) that a state accepts."""

    class_of: np.ndarray
    step: np.ndarray
    accepts: np.ndarray
    first: int
    n_accepting: int

    @classmethod
    def of(cls, trees: list, everywhere: bool) -> Automaton:
        """Subset construction over classes of bytes, then the least automaton. ``everywhere``: matches may begin at any byte."""
        nfa = _Nfa()
        begins, bit_of = [], {}
        for k, tree in enumerate(trees):
            begins.append(nfa.state())
            bit_of[nfa.add(tree, begins[-1])] = 1 << k
        sets = sorted({s[0] for s in nfa.steps if s}, key=sorted)
        _, class_of = np.unique(np.array([[b in s for s in sets] for b in range(256)]), axis=0, return_inverse=True)
        class_of = class_of.ravel()
        member = [int(np.flatnonzero(class_of == c)[0]) for c in range(class_of.max() + 1)]

        def bits(states) -> int:  # a set of states as the bits of a number, of those that take a byte or accept
            return sum(1 << s for s in nfa.closed(states) if nfa.steps[s] or s in bit_of)

        begin = bits(begins)
        moves = {s: [bits([move[1]]) if b in move[0] else 0 for b in member] for s, move in enumerate(nfa.steps) if move}
        none = [begin if everywhere else 0] * len(member)
        numbers, todo, rows, accepts = {begin: 0}, [begin], [], []
        for states in todo:
            own, accepted = [none], 0
            while states:
                s = (states & -states).bit_length() - 1
                states &= states - 1
                if s in moves:
                    own.append(moves[s])
                accepted |= bit_of.get(s, 0)
            accepts.append(accepted)
            row = own[0]
            for more in own[1:]:
                row = [x | y for x, y in zip(row, more)]
            for after in row:
                if after not in numbers:
                    numbers[after] = len(todo)
                    todo.append(after)
            rows.append([numbers[after] for after in row])
        step = np.array(rows)
        accepts = np.array(accepts, np.int64)
        kind, n = np.unique(accepts, return_inverse=True)[1].ravel(), 0
        while kind.max() + 1 != n:  # states are one as long as no byte leads them to different ones
            n = kind.max() + 1
            kind = np.unique(np.column_stack([kind, kind[step]]), axis=0, return_inverse=True)[1].ravel()
        one = np.unique(kind, return_index=True)[1]
        step, accepts, first = kind[step[one]], accepts[one], kind[0]
        order = np.argsort(accepts == 0, kind="stable")
        place = np.argsort(order)
        return cls(class_of, place[step[order]], accepts[order], int(place[first]), int((accepts > 0).sum()))

    def resets(self) -> np.ndarray:
        """Which bytes take every state to the first one."""
        return (self.step == self.first).all(axis=0)[self.class_of]


class Scanner:
    """The automata of some rules; ``scan`` gives the matches in texts that lie end to end."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [_Pattern(r.pattern).tree for r in rules]
        self.starts = Automaton.of([_reversed(t) for t in trees], True)
        self.resets = self.starts.resets()
        self.classes = self.starts.class_of.astype(np.uint8).tobytes()
        self.wide = self.starts.step.shape[1]
        self.flat = (self.starts.step * self.wide).ravel().astype(np.int32)
        self.listed = self.flat.tolist()
        self.own = []
        for t in trees:
            a = Automaton.of([t], False)
            dead = [s for s in range(len(a.step)) if not a.accepts[s] and (a.step[s] == s).all()]
            self.own.append((a.step[:, a.class_of].tolist(), a.first, a.n_accepting, dead[0] if dead else -1))

    @classmethod
    @cache
    def of(cls, rules: tuple[Rule, ...]) -> Scanner:
        """Compiled once a process."""
        return cls(rules)

    def _lanes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of lanes, longest first: a lane ends before a byte that resets, or with its text."""
        free = np.flatnonzero(self.resets[data])
        cuts = free[np.minimum(np.searchsorted(free, np.arange(LANE, len(data), LANE)), len(free) - 1)] if len(free) else free
        edges = np.unique(np.concatenate([[0], cuts, ends]))
        begin, end = edges[:-1], edges[1:]
        by = np.argsort(begin - end, kind="stable")
        return begin[by], end[by]

    def begins(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where some rule has a match that starts there, rising, and the rules' bits."""
        classes = np.frombuffer(data.tobytes().translate(self.classes), np.uint8)
        begin, end = self._lanes(data, ends)
        sizes = end - begin
        state = np.full(len(begin), self.starts.first * self.wide, np.int32)
        limit = self.starts.n_accepting * self.wide
        places, states = [], []
        few = int(sizes[FEW]) if len(sizes) > FEW else 0
        active = np.searchsorted(-sizes, -np.arange(few), side="left")
        for i in range(few):
            k = active[i]
            at = end[:k] - (i + 1)
            now = self.flat[state[:k] + classes[at]]
            state[:k] = now
            hit = np.flatnonzero(now < limit)
            if len(hit):
                places.append(at[hit])
                states.append(now[hit])
        listed = self.listed
        for lane in range(min(FEW, len(sizes))):
            s, a, b = int(state[lane]), int(begin[lane]), int(end[lane]) - few
            for at, c in zip(range(b - 1, a - 1, -1), classes[a:b][::-1].tolist()):
                s = listed[s + c]
                if s < limit:
                    places.append(np.array([at]))
                    states.append(np.array([s]))
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.concatenate(places)
        by = np.argsort(found)
        return found[by], self.starts.accepts[np.concatenate(states)[by] // self.wide]

    def _end(self, rule: int, data: bytes, at: int, stop: int) -> tuple[int, int]:
        """Ends of the shortest and of the longest match of a rule that starts at ``at``."""
        step, s, accepting, dead = self.own[rule]
        shortest = longest = at
        for place in range(at, stop):
            s = step[s][data[place]]
            if s < accepting:
                longest = place + 1
                shortest = longest if shortest == at else shortest
            elif s == dead:
                break
        return shortest, longest

    def scan(self, data: bytes, ends: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Of texts that lie end to end: for each that has any, its matches (start, rule, end), leftmost and longest, none of a rule overlapping, in order."""
        places, bits = self.begins(np.frombuffer(data, np.uint8), ends)
        texts = np.searchsorted(ends, places, side="right")
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k, rule in enumerate(self.rules):
            own = np.flatnonzero(bits >> k & 1)
            free = -1
            for at, text in zip(places[own].tolist(), texts[own].tolist()):
                if at >= free:
                    shortest, free = self._end(k, data, at, int(ends[text]))
                    if free - at >= rule.least and free - shortest + 1 >= rule.tail:
                        begin = int(ends[text - 1]) if text else 0
                        out.setdefault(text, []).append((at - begin, k, free - begin))
        return {text: sorted(found) for text, found in out.items()}


def _runs(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts of a batch end to end, about ``RUN`` bytes at a time, and their ends."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1])
        if size >= RUN:
            yield b"".join(held), np.cumsum([len(h) for h in held])
            held, size = [], 0
    if held:
        yield b"".join(held), np.cumsum([len(h) for h in held])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner.of(rules)
    for batch in batches:
        done = 0
        for data, ends in _runs(batch["bytes"]):
            found = scanner.scan(data, ends)
            spans: list[list[dict]] = [[] for _ in ends]
            for text, matches in found.items():
                own = data[int(ends[text - 1]) if text else 0 : int(ends[text])]
                points = np.arange(len(own) + 1)
                if not own.isascii():  # of a code point its first byte counts
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)])
                spans[text] = [{"kind": rules[k].kind, "start": int(points[a]), "end": int(points[b])} for a, k, b in matches]
            rest = batch.slice(done, len(ends)).drop_columns(["bytes"])
            done += len(ends)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(spans, _SPAN)], [*rest.schema.names, "spans"])


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for each row of ``docs`` (doc_id, text): its secrets as (kind, start, end), in code points, the end exclusive.

    For each rule matches are leftmost, longest and don't overlap; one that is
    too short is dropped, and hides what it covers. Spans come by start, then in
    the rules' order. Null and empty texts have none; a null doc_id stays; rows
    that repeat are each scanned, alike. Very long texts are scanned whole.
    Other columns are left out, whatever their names; an empty table gives no
    rows. Nothing is shuffled.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", text_bytes().alias("bytes")).mapInArrow(lambda it: _scanned(it, rules), schema)


def digests(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Of the rows of ``secrets``: how many spans of each base kind, the digest of all base spans, and all spans as text."""
    kinds = [r.kind for r in base]

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*wanted):
        return F.filter("spans", lambda s: s["kind"].isin(*wanted))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(told(of(*kinds)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
