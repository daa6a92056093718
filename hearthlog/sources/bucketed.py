"""Fact and sensor tables dealt out by sensor when they are written.

Both tables are hashed by sensor into the same number of buckets. The rollup, the latest readings and the join with
sensors then run inside the scan's tasks, without an exchange, in every later query. A bucket is one task, so the
layout suits fleets in which no sensor has more readings than a task should take: ``heaviest_sensor`` tells, and the
layout by day (``sinks.write_readings``) is for the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heaviest_sensor(readings: DataFrame) -> int:
    """Readings of the sensor that has most."""
    counts = readings.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def _write(df: DataFrame, key: str, order: list[str], table: str, path: str, buckets: int) -> DataFrame:
    # Dealt out like the buckets, so that a task writes whole buckets, one file each.
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(*order).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def write_readings(
    readings: DataFrame, table: str, path: str, buckets: int, most: int | None = None
) -> DataFrame:
    """Store readings as ``table``, bucketed by sensor and sorted by sensor and time; returns the stored table.

    With ``most`` a fleet that has a sensor of more readings is refused.
    """
    if most is not None and (n := heaviest_sensor(readings)) > most:
        raise ValueError(f"a sensor has {n} readings, more than one bucket should hold ({most})")
    return _write(readings, "sensor_id", ["sensor_id", "recorded_at"], table, path, buckets)


def write_sensors(sensors: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store sensors as ``table``, bucketed like their readings; returns the stored table."""
    return _write(sensors, "id", ["id"], table, path, buckets)
