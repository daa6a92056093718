"""Quarter-hour statistics in event time: a slot is emitted once, when the watermark passes its end.

Spark drops rows behind the watermark from a windowed aggregate. Here nothing is lost: a stateless keyed step
that knows the watermark moves the event time of such rows up to it, and the aggregate groups by the true slot as
well. A late row thus comes out with the window it arrived in, as a *correction* of its own slot. Emitted slots and
corrections are mergeable partials (``stats.merge_rollups``), so together they are the rollup of all readings.

The slots that are still open lie in the query's state store; ``open_slots`` reads them from there, so the
statistics of the running quarter-hour need no second job.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from hearthlog.functions import zones
from hearthlog.operators import stats
from hearthlog.session import KEYED_STATE
from hearthlog.sources.sinks import write_epoch
from hearthlog.streaming import folding
from hearthlog.streaming.jobs import start

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOT = "15 minutes"
# Keys of the step that moves event times; readings are dealt out evenly, whatever sensor they are of.
LANES = 256


class OnTime(StatefulProcessor):
    """Adds ``event_time``: the reading's time, or just past the watermark where that is later. Keeps no state."""

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Spark takes nothing at or behind the watermark.
        mark = (timerValues.getCurrentWatermarkInMs() + 1) * 1000
        for frame in rows:
            micros = np.maximum(frame["at_micros"].to_numpy(dtype=np.int64), mark)
            yield frame.assign(event_time=pd.to_datetime(micros, unit="us"))

    def close(self) -> None:
        pass


def closed_slots(readings: DataFrame, lateness: str) -> DataFrame:
    """(sensor_id, unit, slot_start, sum_value, n_values, n_detections, correction) as slots close."""
    marked = readings.withWatermark("recorded_at", lateness)
    rows = marked.where(F.col("numeric_value").isNotNull() | F.col("boolean_value")).select(
        F.pmod(F.xxhash64("id"), F.lit(LANES)).alias("lane"),
        "sensor_id",
        "numeric_value",
        "boolean_value",
        "unit",
        # As a number: Spark would drop late rows of a watermarked column.
        F.unix_micros("recorded_at").alias("at_micros"),
    )
    layout = T.StructType([*rows.schema.fields, T.StructField("event_time", T.TimestampType())])
    timed = rows.groupBy("lane").transformWithStateInPandas(
        OnTime(), layout, "Append", "EventTime", eventTimeColumnName="event_time"
    )
    at = F.timestamp_micros("at_micros")
    slot = F.when(at < F.lit(zones.ON_GRID_SINCE).cast("timestamp"), F.date_trunc("second", at)).otherwise(zones.slot_start(at))
    late = zones.slot_start(at) < zones.slot_start(F.col("event_time"))
    return (
        timed.groupBy(
            F.window("event_time", SLOT), "sensor_id", "unit", slot.alias("slot_start"), late.alias("correction")
        )
        .agg(
            F.sum("numeric_value").alias("sum_value"),
            F.count("numeric_value").alias("n_values"),
            F.count_if("boolean_value").alias("n_detections"),
        )
        .drop("window")
    )


def stream_windows(
    readings: DataFrame, out: str, checkpoint: str, lateness: str = "1 hour", available_now: bool = False
) -> StreamingQuery:
    """Write every slot that closes, and corrections of slots that had closed, to ``windows``.

    Slots end a quarter of an hour after they start and close ``lateness`` behind the newest reading. The
    zones of all sensors must be on the quarter-hour grid.
    """
    for name, value in KEYED_STATE.items():
        readings.sparkSession.conf.set(name, value)

    def body(batch: DataFrame, run: str, epoch: int) -> None:
        write_epoch(batch, f"{out}/windows", run, epoch)
        folding.fold(batch.sparkSession, f"{out}/windows", _WINDOWS, _merged, run, epoch)

    return start(closed_slots(readings, lateness), body, checkpoint, available_now)


_WINDOWS = (
    "sensor_id bigint, unit string, slot_start timestamp, sum_value double, n_values bigint, "
    "n_detections bigint, correction boolean"
)


def _merged(partials: DataFrame) -> DataFrame:
    """One partial per slot as it was emitted and one of its corrections."""
    sums = [F.sum(name).alias(name) for name in ("sum_value", "n_values", "n_detections")]
    return partials.groupBy("sensor_id", "unit", "slot_start", "correction").agg(*sums).select(
        "sensor_id", "unit", "slot_start", "sum_value", "n_values", "n_detections", "correction"
    )


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """The closed slots and, apart from them, their corrections."""
    return _merged(folding.read(spark, f"{out}/windows", _WINDOWS))


def open_slots(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The partials of the slots that the last finished micro-batch left open, from the state store."""
    stored = spark.read.format("statestore").option("path", checkpoint).option("operatorId", 0).load()
    # The store names its columns by their place in the aggregate.
    key = F.col("key").cast(
        "struct<window: struct<start: timestamp, end: timestamp>, sensor_id: bigint, unit: string, "
        "slot_start: timestamp, correction: boolean>"
    )
    value = F.col("value").cast("struct<sum_value: double, n_values: bigint, n_detections: bigint>")
    return stored.select(key.alias("k"), value.alias("v")).select("k.*", "v.*").drop("window")


def slots_so_far(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """The rollup of all readings the stream has taken in: closed slots, corrections and open slots."""
    return stats.merge_rollups(
        read_windows(spark, out).drop("correction"), open_slots(spark, checkpoint).drop("correction")
    )
