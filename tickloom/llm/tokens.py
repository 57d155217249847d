"""Token ids of whole texts by the tokenizers library, with bounded caches of words and of the pieces in them.

A byte-level pre-tokenizer always begins a new piece at a space that follows a character other than white space, and
merges never cross pieces. Neither do they at an ASCII mark after an ASCII letter or digit, nor at an ASCII letter
after a lone line feed. So the ids of a text are those of its parts between such places, and parts recur: those of many
texts are hashed at once, only distinct ones are encoded, and the ids are gathered in the order of the text.
"""

from __future__ import annotations

import os
import re
import struct
from array import array

import numpy as np
import pandas as pd

from tickloom.llm.common import hashes_of

#: Words and pieces whose ids are kept, and the longest that are; they bound the memory of a Python worker.
CACHE_WORDS, CACHE_PIECES, CACHE_CHARS = 400_000, 50_000, 40
#: Slots for parts that were seen once, 1 byte each: once a cache of words is half full, it takes only parts seen before.
SEEN = 1 << 22
#: Texts with a space after one of these are encoded by the library as a whole; so are those with added tokens.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_LETTER = np.array([x < 128 and chr(x).isalpha() for x in range(256)])
_ALPHANUMERIC = np.array([x < 128 and chr(x).isalnum() for x in range(256)])
_MARK = ~_ALPHANUMERIC & ~_WHITE & (np.arange(256) < 128)
#: Bytes of text that are encoded together.
TOGETHER = 1 << 19
# The pre-tokenizer's pattern for ASCII text, and the characters that stand for bytes in its pieces
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}


def pieces_of(tokenizer, text: str) -> list[str]:
    """The pieces of a text as the byte-level pre-tokenizer makes them; plain ASCII is split here, which is faster."""
    if text.isascii():
        return [p.translate(_BYTE_CHARS) for p in _ASCII_PIECE.findall(text)]
    return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


_missed: dict[int, int] = {}


def _keep(cache: dict, key, value: bytes, most: int) -> None:
    """Puts a value into a bounded cache: a full one stays as it is, as frequent parts come early, and is emptied only
    after many misses, when the texts have become others."""
    if len(cache) < most:
        cache[key] = value
        return
    _missed[most] = _missed.get(most, 0) + 1
    if _missed[most] > 10 * most:
        cache.clear()
        _missed[most] = 0


class _Pieces(dict):
    """Ids of the pieces of the pre-tokenizer, by the model's merges."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize

    def made(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.made(piece)
        if len(piece) <= CACHE_CHARS:
            _keep(self, piece, found, CACHE_PIECES)
        return found


class Encoder:
    """Little-endian unsigned 32-bit ids, as bytes, of each text (null: empty), as the library's encode() gives them without adding any.

    The tokenizer must split into pieces by a byte-level pre-tokenizer and have no normalizer. Texts that hold one of
    its added tokens, such as <|endoftext|>, are encoded by the library as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise ValueError("texts would be normalized: the ids of a text aren't those of its parts")
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)")
        self.pieces = _Pieces(self.tokenizer)
        self.words: dict[int, bytes] = {}
        self.seen, self.n_seen = bytearray(SEEN), 0

    @staticmethod
    def _piece(part: bytes) -> str | None:
        """A part that is one piece, as the pre-tokenizer makes it: Latin letters, with a space before them or not."""
        letters = part[1:] if part[0] == 32 else part
        if letters.isalpha():  # bytes: ASCII letters alone
            return ("\u0120" if part[0] == 32 else "") + letters.decode("ascii")
        if not part.isascii() and (text := letters.decode("utf-8", "surrogatepass")).isalpha() and max(text) < "\u0250":
            return part.decode("latin-1").translate(_BYTE_CHARS)
        return None

    def ids_of(self, part: bytes) -> bytes:
        """Ids of a part of a text, by its pieces, which are kept."""
        if (piece := self._piece(part)) is not None:
            return self.pieces[piece]
        return b"".join([self.pieces[p] for p in pieces_of(self.tokenizer, part.decode("utf-8", "surrogatepass"))])

    def _word(self, key: int, part: bytes) -> bytes:
        found = self.ids_of(part) if (piece := self._piece(part)) is None else self.pieces.made(piece)
        if len(part) <= CACHE_CHARS and (2 * len(self.words) < CACHE_WORDS or self.again(key)):
            _keep(self.words, key, found, CACHE_WORDS)
        return found

    def again(self, key: int) -> bool:
        """Whether a part was seen before, as far as is remembered; parts that occur once would fill the cache."""
        at = key % SEEN
        if self.seen[at]:
            return True
        self.seen[at] = 1
        self.n_seen += 1
        if 2 * self.n_seen > SEEN:
            self.seen, self.n_seen = bytearray(SEEN), 0
        return False

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that aren't empty."""
        data = b"".join(texts)
        b = np.frombuffer(data, np.uint8)
        begins = np.cumsum([0, *map(len, texts)])
        cut = np.zeros(len(b), bool)
        cut[1:] = (b[1:] == 32) & ~_WHITE[b[:-1]] | _MARK[b[1:]] & _ALPHANUMERIC[b[:-1]]
        line = np.flatnonzero(b[1:-1] == 10) + 1
        cut[line[_LETTER[b[line + 1]] & (_MARK | _ALPHANUMERIC)[b[line - 1]]] + 1] = True
        cut[begins[:-1]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(b))
        code, keys = pd.factorize(hashes_of(b, starts, ends))
        first = np.empty(len(keys), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        keys = keys.tolist()
        ids = list(map(self.words.get, keys))
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = self._word(keys[i], data[starts[first[i]] : ends[first[i]]])
        size = np.array([len(x) for x in ids]) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[code]
        total = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(at[code] - total[:-1], n) + np.arange(total[-1])]
        edges = total[np.searchsorted(starts, begins)]
        return [out[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:])]

    def encode(self, texts: list) -> list[bytes]:
        out, plain, size = [b""] * len(texts), [], 0

        def flush():
            for i, x in zip([i for i, _ in plain], self._plain([x for _, x in plain]) if plain else ()):
                out[i] = x
            plain.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.added.search(text) or not text.isascii() and _WIDE_SPACE.search(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
                continue
            plain.append((i, text.encode("utf-8", "surrogatepass")))
            size += len(plain[-1][1])
            if size >= TOGETHER:
                flush()
                size = 0
        flush()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file; a Python worker keeps it, with its caches, from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops the encoders that this worker keeps. Loading one takes some 0.2 s."""
    _encoders.clear()
    _missed.clear()


def encoded_batches(batch, path: str, characters: int = 500_000):
    """(row, ids) of a record batch's text column, a bounded number of characters at a time."""
    at, texts, size = 0, [], 0
    encode = encoder(path).encode
    for i, text in enumerate(batch.column("text")):
        text = text.as_py()
        texts.append(text)
        size += len(text or "")
        if size >= characters:
            yield from zip(range(at, i + 1), encode(texts))
            at, texts, size = i + 1, [], 0
    yield from zip(range(at, at + len(texts)), encode(texts))
