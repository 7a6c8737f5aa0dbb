"""Token ids of page text, exactly as the tokenizer file gives them, with pieces remembered."""

from __future__ import annotations

import json
import struct
import os
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

# Spark runs one task a core; threads inside a task would only contend.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Characters whose classes, case and composition are the same in every Unicode version in use.
# A soft hyphen, a no-break space and the dotted and dotless i are left to the library.
_PLAIN_POINTS = [p for p in (*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028))
                 if p not in (0xAD, 0x130, 0x131)]


def _ranges(points: list[int]) -> str:
    """A pattern's character ranges for ascending code points."""
    breaks = [0, *(i for i in range(1, len(points)) if points[i] != points[i - 1] + 1), len(points)]
    return "".join(f"\\u{points[a]:04x}-\\u{points[b - 1]:04x}"
                   for a, b in zip(breaks, breaks[1:], strict=False))


def _of_kind(kind: str) -> str:
    return _ranges([p for p in _PLAIN_POINTS if unicodedata.category(chr(p))[0] == kind])


_L, _N, _S = _of_kind("L"), _of_kind("N"), r"\t\n\r "
_PLAIN = re.compile(f"[{_S}{_ranges(_PLAIN_POINTS)}]*")
# The splits of the two supported kinds of tokenizer file, for plain characters. Written with plain
# classes they run twice as fast as with Unicode properties.
BYTE_PATTERN = re.compile(
    f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WORD_PATTERN = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^{_S}{_L}{_N}]+")

_REMEMBERED = 300_000
_LONG = 1 << 18
# Fixed value: how byte-level vocabularies write a blank.
_BLANK_SIGN = "\u0120"
# A special token's string, or a split's look at the next character, reaches this far at most.
GUARD_CHARS = 32


class _Remembered(dict):
    """Piece to the bytes of its ids; a missing piece is asked of the library, memory is bounded.

    When full, what it holds becomes the older half: pieces still in use come back from there.
    """

    def __init__(self, whole: Tokenizer, byte_pieces: bool):
        super().__init__()
        self.whole, self.model = whole, whole.model
        self.byte_pieces = byte_pieces
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece)
        if found is None:
            if self.byte_pieces and piece.isascii() and piece.isprintable():
                # What comes before the merges leaves such a piece alone, but for the sign of a blank.
                ids = [t.id for t in self.model.tokenize(piece.replace(" ", _BLANK_SIGN))]
            else:
                ids = self.whole.encode(piece, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[piece] = found
        return found


class PieceEncoder:
    """Ids of texts under one tokenizer file.

    Byte-pair merges never cross the pieces into which the tokenizer splits a text, so the ids of
    a text are those of its pieces in order, and a piece met again needs no second merge. Pieces
    are encoded by the library itself. A text with a special token's opening, or with characters
    beyond a range where splitting is beyond doubt, goes to the library whole.
    """

    def __init__(self, tokenizer_path: str):
        self.whole = Tokenizer.from_file(tokenizer_path)
        state = json.loads(self.whole.to_str())
        kinds = str(state["pre_tokenizer"])
        self.words = "Removed" in kinds
        self.split = (WORD_PATTERN if self.words else BYTE_PATTERN).findall
        self.known = "Split" in kinds if self.words else "'use_regex': True" in kinds
        self.marks = [t["content"][:2] for t in state["added_tokens"]]
        self.ids = _Remembered(self.whole, self.known and "ByteLevel" in kinds)

    def plain(self, text: str) -> bool:
        return (self.known and not any(m in text for m in self.marks)
                and _PLAIN.fullmatch(text) is not None)

    def pieces(self, text: str) -> list[str]:
        return self.split(text.lower() if self.words else text)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        if len(text) > _LONG:
            return self._encode_long(text)
        if not self.plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.ids.__getitem__, self.pieces(text))), "<u4")

    def _encode_long(self, text: str) -> np.ndarray:
        """Stretch by stretch: each is read from a piece's start to the last sure start in it."""
        parts, at, size = [], 0, _LONG // 2
        while at < len(text):
            starts, before, ids = self.read(text[at:at + size])
            if at + size >= len(text):
                parts.append(ids)
                break
            sure = np.flatnonzero(starts[:-2] <= size - GUARD_CHARS)
            if len(sure) and starts[sure[-1]] > 0:
                parts.append(ids[:before[sure[-1]]])
                at += int(starts[sure[-1]])
                size = _LONG // 2
            else:
                size *= 2
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each piece begins, tokens before it, ids), the text's end as last beginning."""
        if self.plain(text):
            if self.words:
                text = text.lower()
                pieces, starts = [], []
                for match in WORD_PATTERN.finditer(text):
                    pieces.append(match.group())
                    starts.append(match.start())
            else:
                pieces = self.split(text)
                starts = np.cumsum([0, *map(len, pieces)])[:-1]
            coded = [self.ids[p] for p in pieces]
            counts = np.array([len(c) // 4 for c in coded], np.int64)
            return (np.append(np.asarray(starts, np.int64), len(text)),
                    np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
                    np.frombuffer(b"".join(coded), "<u4"))
        code = self.whole.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in code.word_ids], np.int64)
        begin = np.array([o[0] for o in code.offsets], np.int64)
        stop = np.array([o[1] for o in code.offsets], np.int64)
        # A special token has no word; every one of them stands alone.
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (word[1:] < 0)
        # A character may become several pieces; only the first one's start is a place in the text.
        new[1:] &= begin[1:] >= np.maximum.accumulate(stop)[:-1]
        at = np.flatnonzero(new)
        return (np.append(begin[at], len(text)), np.append(at, len(word)).astype(np.int64),
                np.array(code.ids, "<u4"))

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.read(text)[:2]

    def ends_sentence(self) -> np.ndarray:
        """True for each id whose text closes a sentence."""
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            if token.removesuffix("</w>").endswith((".", "!", "?")):
                closes[number] = True
        return closes


_OPEN: dict[str, PieceEncoder] = {}


def encoder(tokenizer_path: str) -> PieceEncoder:
    """One encoder for each worker process and tokenizer file."""
    if tokenizer_path not in _OPEN:
        _OPEN[tokenizer_path] = PieceEncoder(tokenizer_path)
    return _OPEN[tokenizer_path]
