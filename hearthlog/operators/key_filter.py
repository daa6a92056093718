"""Checking new rows against the keys of a large stored table, mostly without reading it.

A key filter is a bitmap of hashed keys, built by Spark's own bitmap aggregate and stored as rows of 32,768 bits,
so it is as distributed as the table. A new key whose bit is not set is certainly new: those are settled by a join of
the batch with the filter. Only the others are compared with the table itself, and if there are none the table is not
scanned. The answer is exact whatever the size of the filter; it only decides how many keys need comparing.

Filters of disjoint sets of rows merge (``merge``), so one is kept up to date by adding the filter of every batch.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.session import cut

# A filter of 2**40 bits lets one in ten of new keys through when it holds a hundred billion.
BITS = 1 << 40


def _place(key: Column, bits: int) -> Column:
    """The bit of a key, from 1 on as Spark's bitmap functions count."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def build(rows: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(bucket, bitmap) of the non-null keys."""
    places = rows.where(key.isNotNull()).select(_place(key, bits).alias("place"))
    return places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")
    )


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all rows of several filters of the same size."""
    return functools.reduce(DataFrame.unionByName, filters).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def marked(rows: DataFrame, key: Column, key_filter: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` with ``key_value`` and ``may_be_stored``: FALSE where the key is certainly not stored, NULL without key."""
    placed = rows.withColumn("key_value", key).withColumn("_place", _place(F.col("key_value"), bits))
    placed = placed.withColumn("_bit", F.bitmap_bit_position("_place"))
    met = placed.join(key_filter, F.bitmap_bucket_number("_place") == F.col("bucket"), "left")
    byte = F.expr("CAST(conv(hex(substring(bitmap, CAST(_bit DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    is_set = F.expr("shiftright(_byte, CAST(_bit % 8 AS INT)) & 1") == 1
    known = F.when(F.col("key_value").isNotNull(), F.coalesce(is_set, F.lit(False)))
    return met.withColumn("_byte", byte).withColumn("may_be_stored", known).drop("_place", "_bit", "_byte", "bucket", "bitmap")


def _hit(suspects: DataFrame, stored: DataFrame, key: Column) -> DataFrame | None:
    """The keys of the ``suspects`` that are stored; None, without a scan, if there are no suspects."""
    suspects = cut(suspects.select("key_value").distinct())
    if suspects.isEmpty():
        return None
    return stored.select(key.alias("key_value")).join(suspects, "key_value", "left_semi").distinct()


def taken_keys(
    batch: DataFrame, stored: DataFrame, key: Column, key_filter: DataFrame, bits: int = BITS
) -> DataFrame:
    """Rows of ``batch`` whose key is stored already or occurs twice in the batch, with ``key_value``.

    ``key`` is an expression over the columns that batch and table share.
    """
    known = cut(marked(batch, key, key_filter, bits))
    twice = known.groupBy("key_value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key_value")
    taken = _hit(known.where("may_be_stored"), stored, key)
    if taken is not None:
        twice = twice.union(taken).distinct()
    return known.join(twice, "key_value", "left_semi").select(*batch.columns, "key_value")


def missing_references(
    batch: DataFrame, parents: DataFrame, reference: str, key_filter: DataFrame, bits: int = BITS
) -> DataFrame:
    """Rows of ``batch`` whose non-null ``reference`` is the id of no stored parent.

    A bit that is not set proves a parent missing; the others are looked up.
    """
    known = cut(marked(batch, F.col(reference), key_filter, bits))
    there = _hit(known.where("may_be_stored"), parents, F.col("id"))
    known = known.where(F.col("key_value").isNotNull())
    left = known if there is None else known.join(there, "key_value", "left_anti")
    return left.select(*batch.columns)
