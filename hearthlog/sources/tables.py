"""Scans of the stored tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog import schema
from hearthlog.functions.zones import utc_date


def read_table(spark: SparkSession, path: str, layout: T.StructType, source: str = "parquet") -> DataFrame:
    """Scan of a stored table with its declared schema (no inference pass)."""
    return spark.read.format(source).schema(layout).load(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Fact scan. The table is partitioned by ``recorded_date``."""
    layout = T.StructType(schema.READINGS.fields + [T.StructField("recorded_date", T.DateType())])
    return spark.read.schema(layout).parquet(path)


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema.SENSORS)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema.USERS)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema.RULES)


def read_challenges(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema.CHALLENGES)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Scan of a table kept in a relational database.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read it with
    several tasks.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def for_owner(df: DataFrame, owner_id: int, row_id: int | None = None) -> DataFrame:
    """Rows of one owner, or one of the owner's rows."""
    owned = df.where(F.col("owner_id") == owner_id)
    return owned if row_id is None else owned.where(F.col("id") == row_id)


def in_range(readings: DataFrame, start: dt.datetime | Column, end: dt.datetime | Column) -> DataFrame:
    """Readings of the half-open span ``[start, end)``.

    With literal bounds the span reaches the scan; on a partitioned table the implied dates prune
    whole partitions as well.
    """
    kept = readings.where((F.col("recorded_at") >= start) & (F.col("recorded_at") < end))
    literal = isinstance(start, dt.datetime) and isinstance(end, dt.datetime)
    if literal and "recorded_date" in readings.columns:
        kept = kept.where(F.col("recorded_date").between(utc_date(start), utc_date(end)))
    return kept


def numeric_sensors(sensors: DataFrame) -> DataFrame:
    """Sensors a threshold rule can watch."""
    return sensors.where(F.col("type").isin(*schema.NUMERIC_SENSOR_TYPES))


def motion_sensors(sensors: DataFrame) -> DataFrame:
    """Sensors an event rule can watch."""
    return sensors.where(F.col("type") == "MOTION")
