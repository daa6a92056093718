"""Sharding along a Hilbert curve, so that each shard covers a small box of the metadata.

Several metadata columns are quantised to ``2**BITS`` cells each and every row gets the index of its cell
on the Hilbert curve through that grid. Rows are put in curve order and the order is cut into runs of
equal row counts (at most one apart). A run is a connected piece of the curve, hence a compact region of
the grid, and minimum and maximum of each column prune files in all dimensions at once.

Quantisation: a value goes by its position among ``2**BITS`` approximate quantiles of its column over the
whole table (a sketch, one small row per dimension), so cells follow the order of the values and hold about as
many rows each. Text is ordered by the six bytes behind what all of a column's values begin with; values that agree in
these share a cell. Null is cell 0.

The order is total: curve index, then a hash of the row's metadata and id, then the id, then the text's
checksum. A cell that a third of all rows share is therefore spread over many range partitions. Ranks
come from one range exchange of narrow rows (no texts): rows are written in order with their place in
their partition, partitions are counted, and the running count of earlier partitions is added; that small
table has one row per partition. Rows equal in every respect may swap ranks; their results are equal.

Null ids, null and empty texts, repeated rows and empty tables are sharded like any other row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog.session import cut

BITS = 6
QUANTILE_ACCURACY = 2000
_TEXT_BYTES = 6  # a double holds them exactly


def hilbert_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with ``bits``-bit coordinates, one array per axis.

    Works from the top bit down. At each level the point's half along every axis, Gray-decoded, gives
    the next ``len(cells)`` bits of the index; reflecting and swapping axes then turns the chosen
    sub-cube into standard position for the next level.
    """
    axes = [np.asarray(c, dtype=np.int64).copy() for c in cells]
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        top, below = 1 << level, (1 << level) - 1
        for k in range(n):
            upper = (axes[k] & top) != 0
            differ = np.where(upper, 0, (axes[0] ^ axes[k]) & below)
            axes[0] = np.where(upper, axes[0] ^ below, axes[0] ^ differ)
            axes[k] = axes[k] ^ differ
    for k in range(1, n):
        axes[k] ^= axes[k - 1]
    flip = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((axes[n - 1] & (1 << level)) != 0, flip ^ ((1 << level) - 1), flip)
    index = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            index = (index << 1) | (((axes[k] ^ flip) >> level) & 1)
    return index


def _in_order(df: DataFrame, d: str) -> Column:
    """A number that grows with the value of a dimension."""
    kind = df.schema[d].dataType
    if isinstance(kind, T.NumericType):
        return F.col(d).cast("double")
    text = F.encode(F.col(d).cast("string"), "UTF-8")
    ends = df.agg(F.min(text), F.max(text)).first()
    low, high = (bytes(end or b"") for end in ends)
    shared = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    behind = F.rpad(F.hex(F.substring(text, shared + 1, _TEXT_BYTES)), 2 * _TEXT_BYTES, "0")
    return F.conv(behind, 16, 10).cast("double")


def _cells(df: DataFrame, dimensions: Sequence[str], bits: int) -> list[Column]:
    """The quantised coordinate of each dimension; all dimensions share one pass for their quantiles."""
    side = 1 << bits
    levels = [i / side for i in range(1, side)]
    values = {d: _in_order(df, d) for d in dimensions}
    found = [F.percentile_approx(value, levels, QUANTILE_ACCURACY).alias(d) for d, value in values.items()]
    row = df.agg(*found).first()

    def cell(d: str) -> Column:
        cuts = row[d] or []
        if not cuts:
            return F.lit(0)
        # A quantile counts as often as it is one, so few values spread over the whole axis by their shares.
        above = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < values[d])
        return F.when(values[d].isNull(), 0).otherwise(F.size(above))

    return [cell(d).cast("long") for d in dimensions]


def curve_position(df: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> Column:
    """The Hilbert index of each row's metadata, as a column for ``df``."""

    @F.pandas_udf("long")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([cells[c].to_numpy() for c in cells.columns], bits))

    named = [c.alias(f"c{i}") for i, c in enumerate(_cells(df, dimensions, bits))]
    return index(F.struct(*named))


def in_order(df: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """``df`` with ``rank`` (0-based place in the order of ``keys``), and its number of rows."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so a window over all of them is a window over a few thousand rows.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.withColumn("rank", F.col("_before") + place).drop("_part", "_before", "_at"), placed.count()


def shard(
    docs: DataFrame,
    dimensions: Sequence[str] = ("source", "lang", "n_chars"),
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, size, checksum, curve index, shard and slot, and the ``carry`` columns.

    Without ``carry`` only narrow rows are moved. With it the named columns travel along, which puts a
    table's full rows in shard order in the same single exchange.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    metadata = [F.col(d).alias(f"_d{i}") for i, d in enumerate(dimensions)]
    rows = docs.select(
        F.col(id_col).alias("_id"),
        *metadata,
        size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    names = [f"_d{i}" for i in range(len(dimensions))]
    rows = rows.withColumn("curve", curve_position(rows, names))
    rows = rows.withColumn("_tie", F.xxhash64("_id", "size", *names))
    ranked, n = in_order(rows, "curve", "_tie", "_id", "text_crc32")
    # Shard s holds ranks ceil(s*n/k) up to ceil((s+1)*n/k).
    of = F.expr(f"CAST((rank * {n_shards}) DIV {max(n, 1)} AS INT)")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) DIV {n_shards}")
    return (
        ranked.withColumn("shard", of)
        .withColumn("slot", F.col("rank") - first)
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            "slot",
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
            *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        )
    )
