"""Benchmark decontamination with SimHash over item-sized windows.

For every benchmark item the documents' windows of as many words as the item has are candidates. A window
is compared in three steps:

1. *Anchors.* Similarity is shared shingle weight, so a window without one shingle of the item has
   similarity zero. Only windows over a shared shingle are fingerprinted; this leaves out nothing.
2. *SimHash in multi-index blocks.* Windows and items get 64-bit fingerprints of their weighted shingles.
   Two fingerprints within r bits differ by at most ``r // BLOCKS`` bits in one of ``BLOCKS`` equal blocks
   (pigeonhole), so blocks are tried first and the whole distance for their hits: exactly the windows within
   the radius pass. The radius is that of the item and the window: shingle weights that the two do not share
   add up to at most d = window + item - 2 * 0.8 * item at similarity 0.8, and a bit can differ only if the
   item's sum of signs for it is at most d. So no window of similarity 0.8 or more is turned away, whatever long
   words stand in it.
3. *Exact similarity.* The share of the item's shingle weight that the window holds, counting repeated
   shingles as often as both have them; a shingle weighs as many bytes as its words have. 0.8 or more is a
   leak. The same without the counts is never less, is known for all windows from running sums, and leaves few
   windows to be counted.

Shingles are five words, lower-cased A to Z; an item with fewer words is one shingle of all its words.
Documents are scanned once and nothing is shuffled. The items are the stated query set: they go to the
tasks in blocks of ``BLOCK_BYTES`` of text at most (one item may exceed it), one pass per block, so a
benchmark of any size works in bounded memory.

Null, blank or short texts hold no window with a shared shingle and have no rows; a document shorter than
the item is one window. Items without words never match; null ids are reported as null; repeated document
or item rows give repeated result rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.tokens import Hasher, Words, mix, shingles

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 28
BLOCKS = 4
BLOCK_BYTES = 8_000_000

RESULT = "doc_id long, item_id long, similarity double, first_word long, n_words long"
_SIGNS = np.arange(64, dtype=np.uint64)


class Item(NamedTuple):
    item_id: int | None
    n_words: int
    shingle: int  # words per shingle
    names: np.ndarray  # distinct shingle hashes, sorted
    counts: np.ndarray
    weights: np.ndarray  # of one occurrence
    fingerprint: np.uint64
    margins: np.ndarray  # sizes of the fingerprint's 64 sums, sorted: how much weight it takes to turn a bit


def _shingled(hashes: np.ndarray, sizes: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and weights of a word sequence with at least ``shingle`` words."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return shingles(hashes, shingle), total[shingle:] - total[:-shingle]


def _sign_sums(names: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums, from zero, of the weighted +1/-1 bits of the shingles: one row per border."""
    bits = ((mix(names)[:, None] >> _SIGNS) & np.uint64(1)).astype(np.int64)
    signed = (2 * bits - 1) * weights[:, None]
    return np.concatenate([np.zeros((1, 64), dtype=np.int64), np.cumsum(signed, axis=0)])


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _SIGNS).sum(axis=1, dtype=np.uint64)


def make_item(item_id: int | None, words: Words) -> Item | None:
    n = len(words.hashes)
    if n == 0:
        return None
    k = min(SHINGLE, n)
    names, weights = _shingled(words.hashes, words.ends - words.starts, k)
    distinct, where, counts = np.unique(names, return_index=True, return_counts=True)
    sums = _sign_sums(names, weights)[-1:]
    return Item(item_id, n, k, distinct, counts, weights[where], _fingerprints(sums)[0], np.sort(np.abs(sums[0])))


def radii(item: Item, window_weights: np.ndarray, threshold: float) -> np.ndarray:
    """Most bits by which windows of these shingle weights and of similarity ``threshold`` can differ from the item."""
    own = (item.counts * item.weights).sum()
    # One more for the rounding of the threshold.
    unshared = window_weights + own - 2 * threshold * own + 1
    return np.searchsorted(item.margins, unshared, side="right")


def within_radius(
    prints: np.ndarray, target: np.uint64, radius: int | np.ndarray = RADIUS, blocks: int = BLOCKS
) -> np.ndarray:
    """Indexes of the fingerprints at most ``radius`` bits (one for all, or each its own) from ``target``."""
    radius = np.broadcast_to(radius, prints.shape)
    differ = prints ^ target
    width = 64 // blocks
    mask = np.uint64((1 << width) - 1)
    hit = np.zeros(len(prints), dtype=bool)
    for b in range(blocks):
        hit |= np.bitwise_count((differ >> np.uint64(b * width)) & mask) <= radius // blocks
    candidates = np.flatnonzero(hit)
    return candidates[np.bitwise_count(differ[candidates]) <= radius[candidates]]


def best_window(item: Item, hashes: np.ndarray, sizes: np.ndarray, hits: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """(similarity, first word, words) of the document's most similar window, the earliest of several.

    ``hits`` are the positions of the document's shingles that the item has too.
    """
    n = min(item.n_words, len(hashes))
    last = len(hashes) - n
    reach = n - item.shingle  # a window over shingle p starts at p - reach at the earliest
    marks = np.zeros(last + 2, dtype=np.int64)
    np.add.at(marks, np.clip(hits - reach, 0, last), 1)
    np.add.at(marks, np.clip(hits, 0, last) + 1, -1)
    starts = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
    best, own = None, (item.counts * item.weights).sum()
    # Separate stretches of starts, each at most 4,096 windows, bound the memory of the bit sums.
    pieces = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
    for stretch in pieces:
        for at in range(0, len(stretch), 4096):
            begin = stretch[at : at + 4096]
            lo, hi = begin[0], begin[-1] + n
            names, weights = _shingled(hashes[lo:hi], sizes[lo:hi], item.shingle)
            sums = _sign_sums(names, weights)
            rows = begin - lo
            prints = _fingerprints(sums[rows + reach + 1] - sums[rows])
            where = np.searchsorted(item.names, names).clip(max=len(item.names) - 1)
            shared = np.where(item.names[where] == names, where, len(item.names))
            whole = np.concatenate([[0], np.cumsum(weights)])
            shares = np.concatenate([[0], np.cumsum(np.append(item.weights, 0)[shared])])
            near = within_radius(prints, item.fingerprint, radii(item, whole[rows + reach + 1] - whole[rows], threshold))
            most = (shares[rows + reach + 1] - shares[rows]) / own
            for k in near[most[near] >= threshold]:
                if best and most[k] <= best[0]:
                    continue
                row = rows[k]
                have = np.bincount(shared[row : row + reach + 1], minlength=len(item.names) + 1)[:-1]
                common = (np.minimum(have, item.counts) * item.weights).sum()
                similarity = float(common / own)
                if similarity >= threshold and (best is None or similarity > best[0]):
                    best = similarity, int(begin[k]), int(n)
    return best


class Index:
    """Items by their shingles, for one block of the benchmark."""

    def __init__(self, ids: pa.Array, texts: pa.Array) -> None:
        hasher = Hasher()
        self.items: list[Item] = []
        for k in range(len(texts)):
            for words in hasher.words(texts.slice(k, 1)):
                item = make_item(ids[k].as_py(), words)
                if item:
                    self.items.append(item)
        self.by_size = {}
        for k in sorted({i.shingle for i in self.items}):
            own = [j for j, i in enumerate(self.items) if i.shingle == k]
            names = np.concatenate([self.items[j].names for j in own])
            owners = np.repeat(own, [len(self.items[j].names) for j in own])
            order = np.argsort(names, kind="stable")
            names, owners = names[order], owners[order]
            # A bitmap of name prefixes turns most of the corpus away without a search.
            seen = np.zeros(1 << 20, dtype=bool)
            seen[names >> np.uint64(44)] = True
            self.by_size[k] = names, owners, seen

    def leaks(self, words: Words, threshold: float) -> Iterator[tuple[int, tuple[int | None, float, int, int]]]:
        """(text, (item, similarity, first word, words)) of every leak in a run of texts."""
        sizes = words.ends - words.starts
        for k, (names, owners, seen) in self.by_size.items():
            found = shingles(words.hashes, k)
            at = np.flatnonzero(seen[found >> np.uint64(44)])
            lo = np.searchsorted(names, found[at], side="left")
            hi = np.searchsorted(names, found[at], side="right")
            text = np.searchsorted(words.bounds, at, side="right") - 1
            inside = (hi > lo) & (at + k <= words.bounds[text + 1])  # not across two texts
            at, lo, hi, text = at[inside], lo[inside], hi[inside], text[inside]
            n = hi - lo
            owner = owners[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at, text = np.repeat(at, n), np.repeat(text, n)
            order = np.lexsort((at, owner, text))
            at, text, owner = at[order], text[order], owner[order]
            cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(owner) != 0)) + 1
            for hits in np.split(np.arange(len(at)), cuts) if len(at) else []:
                t, item = int(text[hits[0]]), self.items[owner[hits[0]]]
                a, b = words.bounds[t], words.bounds[t + 1]
                best = best_window(item, words.hashes[a:b], sizes[a:b], at[hits] - a, threshold)
                if best:
                    yield t, (item.item_id, *best)


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's (ids, texts) in blocks of bounded size, ready for the tasks."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    for block in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block).toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast((part["i"].to_pylist(), part["t"].to_pylist()))


def _index(block: Broadcast) -> Index:
    ids, texts = block.value
    return Index(pa.array(ids, pa.int64()), pa.array(texts, pa.string()))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item it leaks: the most similar window, in words of the document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))

    def search(block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hasher = _index(block), Hasher()
            for batch in batches:
                out = []
                for words in hasher.words(batch.column("body")):
                    for t, leak in index.leaks(words, threshold):
                        out.append((batch.column("id")[words.first + t].as_py(), *leak))
                columns = list(zip(*out)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        return rows.mapInArrow(run, RESULT)

    return reduce(DataFrame.union, map(search, _blocks(benchmark, item_col, item_text_col, block_bytes)))


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows that leak no item, decided where they are scanned; nothing is joined or moved."""

    def clean(rows: DataFrame, block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hasher = _index(block), Hasher()
            for batch in batches:
                stays = np.ones(batch.num_rows, dtype=bool)
                for words in hasher.words(batch.column(text_col).cast(pa.large_string())):
                    for t, _ in index.leaks(words, threshold):
                        stays[words.first + t] = False
                yield batch.filter(pa.array(stays))

        return rows.mapInArrow(run, rows.schema)

    return reduce(clean, _blocks(benchmark, item_col, item_text_col, block_bytes), docs)
