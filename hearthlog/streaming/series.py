"""Daily and hourly statistics as a stored table that a stream keeps up to date.

The table holds a mergeable cell per sensor, local date and hour: sum, number of values, detections. Every
micro-batch adds the cells of its own readings and folding merges them, so a micro-batch costs what it brings, a late
reading reaches its day like any other, and nothing is computed twice. Series are read from the cells with the same
filling of gaps as from readings.

A cell's local date follows from the sensor's zone when its readings came in; a sensor that moves to another zone
keeps the past days it had.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hearthlog.operators import stats
from hearthlog.sources.sinks import write_epoch
from hearthlog.streaming import folding
from hearthlog.streaming.jobs import Table, start

_CELLS = "sensor_id bigint, local_date date, local_hour int, sum_value double, n_values bigint, n_detections bigint"


def stream_series(
    readings: DataFrame, sensors: Table, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the cells of arriving readings in ``cells``."""

    def body(batch: DataFrame, run: str, epoch: int) -> None:
        write_epoch(stats.hour_cells(batch, sensors()), f"{out}/cells", run, epoch)
        folding.fold(batch.sparkSession, f"{out}/cells", _CELLS, stats.merge_cells, run, epoch)

    return start(readings, body, checkpoint, available_now)


def read_cells(spark: SparkSession, out: str) -> DataFrame:
    return stats.merge_cells(folding.read(spark, f"{out}/cells", _CELLS))


def daily_series(spark: SparkSession, out: str, sensors: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The seven-day series of every sensor."""
    return stats.daily_from_cells(read_cells(spark, out), sensors, as_of)


def hourly_series(spark: SparkSession, out: str, sensors: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The hours of every sensor's current day."""
    return stats.hourly_from_cells(read_cells(spark, out), sensors, as_of)
