"""Fill-in-the-middle: cut a text at two unit boundaries and put the middle last.

A unit is a word with the white space before it; white space at the end of a text is a unit of its own. The
text's bytes are cut into fixed blocks, and a Fenwick tree over the blocks stores how many units end in them and
how many code points start in them. The block in which the k-th unit ends is found by binary lifting down the
tree, the boundary then inside that block only, and its place in code points from the tree's prefix sum and the
same block. A text of any length thus costs one vectorised pass for the counts and two descents.

Only three numbers per text come back from Python: texts are put together by Spark, which also rebuilds them.
Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>``
middle, ``plain`` is the text itself. All draws come from a hash of seed and id, so a repeated task gives
the same cut.

Null texts count as empty; empty texts, and texts that contain a mark, stay plain. A null id draws like an
empty one. Repeated rows give equal results, empty tables none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog.llm.tokens import CHUNK_BYTES

SEED = 42
RATE = 50  # percent of texts that are cut
SPM = 80  # percent of those in the form spm
BLOCK = 1024
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Fenwick:
    """Prefix sums of fixed counts with descent: ``tree[i]`` covers the ``i & -i`` blocks up to block ``i``."""

    def __init__(self, counts: np.ndarray) -> None:
        n = len(counts)
        sums = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(n + 1)
        self.tree = sums[at] - sums[at - (at & -at)]
        self.n = n

    def before(self, block: int) -> int:
        """The sum of the first ``block`` blocks."""
        total = 0
        while block:
            total += int(self.tree[block])
            block &= block - 1
        return total

    def find(self, k: int) -> tuple[int, int]:
        """The block that holds the ``k``-th item (from 1), and how many items stand before that block."""
        block, seen, step = 0, 0, 1 << max(self.n.bit_length() - 1, 0)
        while step:
            ahead = block + step
            if ahead <= self.n and seen + self.tree[ahead] < k:
                block, seen = ahead, seen + int(self.tree[ahead])
            step >>= 1
        return block, seen


class Units:
    """Unit ends and code points of one text, given as flags per byte."""

    def __init__(self, ends: np.ndarray, leads: np.ndarray, block: int = BLOCK) -> None:
        self.ends, self.leads, self.block = ends, leads, block
        starts = np.arange(0, len(ends), block)
        self.units = Fenwick(np.add.reduceat(ends, starts, dtype=np.int64) if len(starts) else starts)
        self.points = Fenwick(np.add.reduceat(leads, starts, dtype=np.int64) if len(starts) else starts)
        self.n = self.units.before(self.units.n)

    def chars_to(self, k: int) -> int:
        """Code points in the first ``k`` units."""
        if k == 0:
            return 0
        block, seen = self.units.find(k)
        start = block * self.block
        inside = np.flatnonzero(self.ends[start : start + self.block])
        end = start + int(inside[k - seen - 1]) + 1
        return self.points.before(block) + int(np.count_nonzero(self.leads[start:end]))


def _flags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether a unit ends with it, and whether a code point starts there."""
    word = ~_BLANK[data]
    ends = np.zeros(len(data), dtype=bool)
    ends[:-1] = word[:-1] & ~word[1:]
    # The last byte of a text always ends a unit.
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = True
    return ends, (data & 0xC0) != 0x80


def cut_places(texts: pa.Array, first: pa.Array, second: pa.Array, block: int = BLOCK) -> pa.Array:
    """(n, prefix_chars, middle_chars) of every text, cut after ``first % (n + 1)`` and ``second % (n + 1)`` units."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    whole = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    draws = [np.asarray(d.fill_null(0), dtype=np.int64) for d in (first, second)]
    found = np.zeros((3, n), dtype=np.int64)
    at = 0
    while at < n:
        # Runs of texts of about a chunk; one text is never cut.
        to = int(np.searchsorted(raw, raw[at] + CHUNK_BYTES, side="right")) - 1
        to = min(n, max(to, at + 1))
        offsets = raw[at : to + 1] - raw[at]
        ends, leads = _flags(whole[raw[at] : raw[to]], offsets)
        for k in range(at, to):
            own = slice(offsets[k - at], offsets[k - at + 1])
            units = Units(ends[own], leads[own], block)
            low, high = sorted(int(d[k]) % (units.n + 1) for d in draws)
            prefix = units.chars_to(low)
            found[:, k] = units.n, prefix, units.chars_to(high) - prefix
        at = to
    return pa.StructArray.from_arrays([pa.array(row) for row in found], names=["n", "prefix_chars", "middle_chars"])


_PLACES = T.StructType([T.StructField(name, T.LongType()) for name in ("n", "prefix_chars", "middle_chars")])


@F.arrow_udf(_PLACES)
def _places(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    return cut_places(texts, first, second)


def infill(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = SEED, rate: int = RATE, spm: int = SPM
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; the counts are null for plain texts."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), digest.alias("_h"))
    placed = rows.withColumn("_at", _places("_t", draw(0), draw(1)))
    text, a, m = F.col("_t"), F.col("_at.prefix_chars"), F.col("_at.middle_chars")
    marked = F.lit(False)
    for mark in ("<P>", "<S>", "<M>"):
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (draw(2) % 100 >= rate), "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm")
    placed = placed.withColumn("form", form)
    part = lambda start, length: F.substring(text, start.cast("int"), length.cast("int"))
    prefix, middle, suffix = part(F.lit(1), a), part(a + 1, m), part(a + m + 1, F.char_length(text))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
        .when(F.col("form") == "spm", F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle))
        .otherwise(text)
    )
    cut_ = F.col("form") != "plain"
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_at.n").alias("n"),
        "form",
        F.when(cut_, a).alias("prefix_chars"),
        F.when(cut_, m).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``infill`` turned into ``output``."""
    body = lambda text, mark: F.substring(F.substring_index(text, mark, 1), F.lit(4), F.char_length(text))
    after = lambda text, mark: F.substring_index(text, mark, -1)
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    psm = F.concat(body(output, "<S>"), after(output, "<M>"), upto(after(output, "<S>"), "<M>"))
    spm = F.concat(upto(after(output, "<P>"), "<M>"), after(output, "<M>"), body(output, "<P>"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """The rows of ``infill`` with the checksums of output and rebuilt text in place of the output."""
    return made.withColumns(
        {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    ).drop("output")
