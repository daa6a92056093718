"""Subword ids from a public byte-level vocabulary, for whole blocks of words at once.

A word is spelled with a leading blank and cut greedily into the longest pieces of the chosen
vocabulary: all single bytes, so nothing is out of vocabulary, and the pieces of the public list that the
corpus uses most. The tokenizer is not trained; only its pieces are counted.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa

from hearthlog.llm.tokens import CHUNK_BYTES, Hasher

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LONGEST = 7  # bytes of a piece
SIZE = 1024  # ids: bytes, chosen pieces, and the end of the text
END = SIZE - 1
CHOSEN = SIZE - 257

_MASKS = [np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * n)) - 1)) for n in range(1, LONGEST + 1)]


@lru_cache
def public_pieces(path: str) -> list[bytes]:
    """Lower-case pieces of 2 to ``LONGEST`` bytes without inner white space, in the list's order."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    usable = re.compile(rb" ?[^A-Z\x09-\x0d\x20]+\Z")
    return [p for p in pieces if 2 <= len(p) <= LONGEST and usable.match(p)]


def _key(piece: bytes) -> int:
    """The piece at the top of 64 bits and its length at the bottom."""
    return int.from_bytes(piece.ljust(8, b"\0"), "big") | len(piece)


class Pieces:
    """A set of pieces with ids; bytes have ids 0 to 255."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        keys = np.array([_key(p) for p in pieces], dtype=np.uint64)
        # Open addressing in a table at most one eighth full; probing ends at the longest run in it.
        self._bits = max(10, int(np.ceil(np.log2(8 * max(len(pieces), 1)))))
        self._keys = np.zeros(1 << self._bits, dtype=np.uint64)
        self._ids = np.zeros(1 << self._bits, dtype=np.int32)
        self._probes = 1
        for id_, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            probe = 0
            while self._keys[(slot + probe) & ((1 << self._bits) - 1)]:
                probe += 1
            at = (slot + probe) & ((1 << self._bits) - 1)
            self._keys[at], self._ids[at] = key, 256 + id_
            self._probes = max(self._probes, probe + 1)
        self._lengths = sorted({len(p) for p in pieces}, reverse=True)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of keys, -1 where there is none."""
        slots, found = self._slots(keys), np.full(len(keys), -1, dtype=np.int32)
        for probe in range(self._probes):
            at = (slots + probe) & ((1 << self._bits) - 1)
            hit = self._keys[at] == keys
            found[hit] = self._ids[at[hit]]
        return found

    def cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the pieces of word k are ``ids[bounds[k]:bounds[k + 1]]``."""
        lengths = ends - starts + 1
        total = np.concatenate([[0], np.cumsum(lengths)])
        n = int(total[-1])
        spelled = np.zeros(n + 8, dtype=np.uint8)
        source = np.arange(n) + np.repeat(starts - 1 - total[:-1], lengths)
        spelled[:n] = data[np.maximum(source, 0)]
        spelled[total[:-1]] = 32
        packed = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            packed |= spelled[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
        at, word = total[:-1].copy(), np.arange(len(starts))
        rows, places, ids = [], [], []
        while len(word):
            room = total[word + 1] - at
            best, step = spelled[at].astype(np.int32), np.ones(len(word), dtype=np.int64)
            seek = np.arange(len(word))
            for size in self._lengths:
                fits = seek[room[seek] >= size]
                found = self._find((packed[at[fits]] & _MASKS[size - 1]) | np.uint64(size))
                hit = found >= 0
                best[fits[hit]], step[fits[hit]] = found[hit], size
                seek = seek[step[seek] == 1]
            rows.append(word)
            places.append(at)
            ids.append(best)
            at = at + step
            more = at < total[word + 1]
            at, word = at[more], word[more]
        row = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        place = np.concatenate(places) if places else row
        ordered = np.zeros(n + 1, dtype=np.int32)
        used = np.zeros(n + 1, dtype=bool)
        ordered[place], used[place] = flat, True
        counts = np.bincount(row, minlength=len(starts))
        return ordered[used], np.concatenate([[0], np.cumsum(counts)])


class Lexicon(NamedTuple):
    """Distinct words of a group of texts, and the texts as word numbers."""

    first: int  # index of the first text
    hashes: np.ndarray  # of the distinct words
    starts: np.ndarray  # a place of each in ``data``
    ends: np.ndarray
    data: np.ndarray
    numbers: np.ndarray  # of all words in order
    bounds: np.ndarray  # of the texts in ``numbers``


def lexicons(texts: pa.Array, hasher: Hasher, group_bytes: int = 8 * CHUNK_BYTES):
    """The texts in groups of about ``group_bytes`` (a text is never cut), as lexicons."""
    held: list = []
    size = 0
    for w in hasher.words(texts):
        held.append(w)
        size += len(w.data)
        if size >= group_bytes:
            yield _lexicon(held)
            held, size = [], 0
    if held:
        yield _lexicon(held)


def _lexicon(held: list) -> Lexicon:
    shift = np.concatenate([[0], np.cumsum([len(w.data) for w in held])])
    words = np.concatenate([[0], np.cumsum([len(w.hashes) for w in held])])
    hashes = np.concatenate([w.hashes for w in held])
    starts = np.concatenate([w.starts + s for w, s in zip(held, shift)])
    ends = np.concatenate([w.ends + s for w, s in zip(held, shift)])
    bounds = np.concatenate([*[w.bounds[:-1] + n for w, n in zip(held, words)], words[-1:]])
    numbers, distinct = pd.factorize(hashes)
    place = np.zeros(len(distinct), dtype=np.int64)
    place[numbers[::-1]] = np.arange(len(numbers))[::-1]
    data = np.concatenate([w.data for w in held])
    return Lexicon(held[0].first, distinct, starts[place], ends[place], data, numbers, bounds)


def ragged(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' values one after another, and the border of each row."""
    counts = bounds[rows + 1] - bounds[rows]
    border = np.concatenate([[0], np.cumsum(counts)])
    index = np.arange(border[-1]) + np.repeat(bounds[rows] - border[:-1], counts)
    return values[index], border


