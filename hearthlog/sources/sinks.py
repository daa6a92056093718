"""Writers of the sensor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F


def by_day(readings: DataFrame, clustered: bool = True) -> DataFrameWriter:
    """A writer of readings in the layout of the fact table, see ``write_readings``."""
    dated = readings.withColumn("recorded_date", F.to_date("recorded_at"))
    if clustered:
        dated = dated.hint("rebalance", "recorded_date", "sensor_id").sortWithinPartitions(
            "recorded_date", "sensor_id", "recorded_at"
        )
    return (
        dated.write.partitionBy("recorded_date")
        .option("parquet.bloom.filter.enabled#sensor_id", "true")
        .option("parquet.bloom.filter.expected.ndv#sensor_id", "10000")
    )


def write_readings(accepted: DataFrame, path: str, clustered: bool = True) -> None:
    """Append accepted readings to the fact table, one folder per UTC day.

    ``clustered`` gathers each sensor's day into one file, sorted by sensor and time. Later jobs then
    meet a sensor in one task per day: their map-side aggregates and per-sensor limits shrink the data
    before any exchange, and lookups skip row groups by their bounds and Bloom filters. The exchange is
    a rebalancing one, so AQE cuts a sensor of any weight into files of the advisory size and merges
    light ones; unlike a range partitioning it does not compute the rows twice to sample them.
    """
    by_day(accepted, clustered).mode("append").parquet(path)


def write_rejects(rejected: DataFrame, path: str) -> None:
    """Append rejected requests to the quarantine table, one folder per outcome."""
    rejected.write.mode("append").partitionBy("outcome").parquet(path)


def write_epoch(df: DataFrame, path: str, run: str, epoch: int, *partitions: str) -> None:
    """Write the rows of one micro-batch under a folder of its own.

    ``run`` is the streaming query's persistent id, which its checkpoint keeps. A replayed batch
    overwrites its own folder, so every row is kept exactly once; a query with another checkpoint has
    another id and leaves the rows of earlier ones alone.
    """
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/run={run}/epoch={epoch}")


def hourly_json(hour: Column, value: Column) -> Column:
    """Aggregate: the hourly series of a group as a JSON array in hour order, nulls kept."""
    series = F.array_sort(F.collect_list(F.struct(hour.alias("hour"), value.alias("value"))))
    return F.to_json(series, {"ignoreNullFields": "false"})
