"""Whole-text encoding with a public tokenizer file, memoised by white-space chunk and by piece.

The ids are those of the library's `encode(text, add_special_tokens=False)`. The encoders used here
cut a text into pieces with a pattern before merging, and merge within a piece only; a piece never
crosses from a visible character to the white space after it. So a text's ids are those of its
white-space chunks in order, and a chunk's those of its pieces. Chunks and pieces repeat: each worker
looks up chunks, cuts new ones with the encoder's own pattern, and lets the library's model merge each
new piece (the byte-level step before it is a fixed table of characters).

The library takes a text whole if it holds characters outside the plain range (other white space,
control characters, marks that normalisation would join) or `<|`, with which the strings of
special tokens begin: the library gives such a string its own id.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from operator import attrgetter

import numpy as np
import regex

#: Anything but printable ASCII, space, newline, tab, return and letters that normalisation and lower-casing take one by one.
OUTSIDE = re.compile("[^ -~\n\t\r\xa1-įı-ɏ]")
SPECIAL = "<|"  # how the strings of special tokens begin
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space beyond single spaces and single line ends: such texts are cut by CHUNK.
SPACED = ("  ", "\n ", " \n", "\n\n", "\t", "\r")
CHUNKS, PIECES = 500_000, 100_000
LONGEST = 64
LINE = "\x02"
ID = attrgetter("id")

def _byte_level() -> dict[int, str]:
    """Byte to character of the byte-level step: visible ones stand for themselves, the others follow from U+0100 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LEVEL = _byte_level()
SPACE = BYTE_LEVEL[32]
VISIBLE = [BYTE_LEVEL.get(b, chr(b)) for b in range(256)]
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = frozenset(".,;:!?")
_encoders: dict[str, "Encoder"] = {}


class _Memo(dict):
    """A dictionary that makes what it lacks. When full it starts anew, but takes what it is asked for from the last one first."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.last = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.last.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.limit:
                self.last = dict(self)
                self.clear()
            self[key] = value
        return value


def _split_pattern(part: dict | None) -> str | None:
    """The pattern of the encoder's split step; None if it has another kind."""
    for p in (part or {}).get("pretokenizers", [part or {}]):
        if p.get("type") == "Split":
            return p["pattern"].get("Regex")
        if p.get("type") == "ByteLevel" and p.get("use_regex", True) and not p.get("add_prefix_space"):
            return GPT2
    return None


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        normalizer = json.dumps(spec["normalizer"])
        self.lower = '"Lowercase"' in normalizer and "\\\\s+" in normalizer  # white space only separates, case is dropped
        pattern = _split_pattern(spec["pre_tokenizer"])
        self.pattern = regex.compile(pattern) if pattern else None
        self.model = self.tokenizer.model if '"ByteLevel"' in json.dumps(spec["pre_tokenizer"]) else None
        self.plain = self.model is not None and pattern == GPT2
        self.pieces = _Memo(self._piece, PIECES)
        self.chunks = _Memo(self._chunk, CHUNKS)
        self.words = _Memo(self._word, CHUNKS)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if self.model is None:
            return self._whole(piece)
        if not piece.isascii() or "\n" in piece or "\t" in piece or "\r" in piece:
            piece = "".join(map(VISIBLE.__getitem__, piece.encode()))
        elif " " in piece:
            piece = piece.replace(" ", SPACE)
        return array("I", map(ID, self.model.tokenize(piece))).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha():  # one piece
            return self._piece(chunk)
        return b"".join([self._known(p) for p in self.pattern.findall(chunk)])

    def _known(self, piece: str) -> bytes:
        """The ids of a piece; those of plain words are in the memo that texts are looked up in."""
        if self.lower and piece.isalpha():
            return self.chunks[piece]
        if not self.lower and piece[0] == " " and piece[1:].isalpha():
            return self.words[piece[1:]]
        return self.pieces[piece]

    def _word(self, word: str) -> bytes:
        """A word after a space; after LINE, one at the start of a line; or a line's end."""
        if word == "\n":
            return self._piece(word)
        if self.plain and word:
            if word.isalpha():  # one piece
                return array("I", map(ID, self.model.tokenize(SPACE + (word if word.isascii() else "".join(map(VISIBLE.__getitem__, word.encode())))))).tobytes()
            if word[-1] in MARKS and word[:-1].isalpha():  # two pieces
                return self.words[word[:-1]] + self.pieces[word[-1]]
        word = word[1:] if word[:1] == LINE else " " + word
        return self._chunk(word) if word else b""

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.pattern is None or SPECIAL in text or OUTSIDE.search(text):
            return self._whole(text)
        if self.lower:
            chunks = self.chunks
            return b"".join([chunks[c] for c in text.lower().split()])
        if any(x in text for x in SPACED) or text[0].isspace() or text[-1].isspace():
            chunks = self.chunks
            return b"".join([chunks[c] for c in CHUNK.findall(text)])
        return b"".join(map(self.words.__getitem__, (LINE + text.replace("\n", f" \n {LINE}")).split(" ")))


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
