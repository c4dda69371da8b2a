"""Byte-level BPE ids by the ``tokenizers`` library, one memo of words a worker.

A byte-level BPE splits text into words, punctuation runs and white space
before it merges, so ids of a text are the ids of its parts joined. Texts are
cut where this split is certain, each part is encoded once a worker by the
library, and the memo holds the ids as little-endian 32-bit strings.
"""

from __future__ import annotations

import re

import numpy as np

#: Where a cut is certain: one space between two characters that aren't white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Marks that always form a run of their own after letters (an apostrophe may open a contraction).
_MARKS = ",.;:!?%&$#*|"
#: Texts of these bytes alone (letters, spaces, line ends, full stops, commas) can also be cut before each mark.
_PLAIN = b" \n.," + bytes(range(65, 91)) + bytes(range(97, 123)) + b"\xc3" + bytes(range(0x80, 0xC0))
_RUNS = ("..", ",,", ".,", ",.", "\u00d7", "\u00f7")
_MOST = 1_000_000


def default_tokenizer() -> str:
    """Path of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next free code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Unsure(Exception):
    """A part whose ends are white space or nothing: the text needs the careful cut."""


class _Parts(dict):
    """Parts of texts, each with its leading space if any, to packed ids; asks the library once for each."""

    def __init__(self, tokenizer):
        super().__init__()
        self.whole, self.tokenize, self.letters = tokenizer.encode, tokenizer.model.tokenize, str.maketrans(_byte_letters())

    def __missing__(self, part: str) -> bytes:
        if part != "\n" and (not part or part[-1].isspace() or part[:2].isspace()):
            raise _Unsure
        if len(self) >= _MOST:
            self.clear()
        out = self[part] = self.encoded(part)
        return out

    def encoded(self, part: str) -> bytes:
        core = part.removeprefix(" ")
        if core.isalpha() and (core.isascii() or max(core) < "\u0250") or part == "\n":
            return np.array([t.id for t in self.tokenize(part.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()
        word = part.rstrip(_MARKS)
        if len(word) < len(part) and word[-1:].isalpha() and word[-1] < "\u0250":
            return self[word] + self[part[len(word) :]]
        left, line, right = part.partition("\n")
        if line and left.strip() and right and not left[-1].isspace() and not right[0].isspace():
            return self[left] + self["\n"] + self[right]
        return np.array(self.whole(part, add_special_tokens=False).ids, "<u4").tobytes()


class Encoder:
    """``ids(text)``: packed little-endian 32-bit ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.marks = [x.content for x in tokenizer.get_added_tokens_decoder().values() if x.content]
        self.parts = _Parts(tokenizer)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One a worker, whatever the number of tasks."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.marks):  # a mark of the vocabulary's own, which may be more than its characters
            return np.array(self.parts.whole(text, add_special_tokens=False).ids, "<u4").tobytes()
        cut = text.replace(" ", "\0 ")
        if not text.encode().translate(None, _PLAIN) and not any(x in text for x in _RUNS):
            cut = cut.replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0")
        elif "\0" in text:
            return np.array(self.parts.whole(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return b"".join(map(self.parts.__getitem__, cut.split("\0")))
        except _Unsure:
            first, *rest = _CUT.split(text)
            return self._careful(first) + b"".join(self._careful(" " + x) for x in rest)

    def _careful(self, part: str) -> bytes:
        try:
            return self.parts[part]
        except _Unsure:
            return np.array(self.parts.whole(part, add_special_tokens=False).ids, "<u4").tobytes()
