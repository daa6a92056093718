"""Vectorised words of Arrow text batches: hashes and positions without a Python loop over words.

Words are maximal runs without the six ASCII white-space characters, compared after lower-casing A to Z.
Both rules concern single bytes only, so they hold on UTF-8 bytes as they stand. A word's hash is a
polynomial in its bytes modulo 2**64, read off a running sum over the whole chunk, then mixed with the
word's length; the running sum makes the cost per byte the same for one long text and for many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every output bit depends on every input bit."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


class Words(NamedTuple):
    """Words of a run of texts: text k owns words ``bounds[k]`` to ``bounds[k + 1]``."""

    first: int  # index of the first text in the batch
    hashes: np.ndarray  # uint64
    bounds: np.ndarray  # int64
    starts: np.ndarray  # byte positions in ``data``
    ends: np.ndarray
    data: np.ndarray  # the texts' bytes, A-Z lower-cased
    offsets: np.ndarray  # of the texts in ``data``


class Hasher:
    """Holds the power tables, which grow to the longest chunk seen."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(0, dtype=np.uint64)

    def span_hashes(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ranges of ``values`` (uint64), each from one running sum over all of them."""
        n = len(values) + 1
        if len(self._up) < n:
            self._up, self._down = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.zeros(n, dtype=np.uint64)
        np.cumsum((values + np.uint64(1)) * self._up[: n - 1], out=sums[1:])
        value = (sums[ends] - sums[starts]) * self._down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self, texts: pa.Array, fold: bool = True) -> Iterator[Words]:
        """The words of ``texts``, in runs of texts of about ``CHUNK_BYTES`` (one text is never cut).

        A null text has no words.
        """
        texts = texts.cast(pa.large_string())
        n = len(texts)
        raw = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        body = texts.buffers()[2]
        whole = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(raw, raw[first] + CHUNK_BYTES, side="right")) - 1
            last = min(n, max(last, first + 1))
            data = whole[raw[first] : raw[last]]
            data = _LOWER[data] if fold else data
            offsets = raw[first : last + 1] - raw[first]
            yield self._split(first, data, offsets)
            first = last

    def _split(self, first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~_BLANK[data]
        starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        # A word never runs over the border of two texts.
        borders = offsets[1:-1]
        borders = np.unique(borders[(borders > 0) & (borders < len(data))])
        borders = borders[inside[borders] & inside[borders + 1]]
        if len(borders):
            starts = np.sort(np.concatenate([starts, borders]))
            ends = np.sort(np.concatenate([ends, borders]))
        hashes = self.span_hashes(data.astype(np.uint64), starts, ends)
        return Words(first, hashes, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words."""
    n = len(hashes) - size + 1
    value = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        value = value * np.uint64(_BASE) + hashes[k : k + n]
    return mix(value)
