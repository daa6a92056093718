"""Structured Streaming queries.

Every sink writes one folder per query and micro-batch and overwrites it on a replay, so a restarted
query leaves each row exactly once, and one with a new checkpoint adds to what is there. Tables on the
static side (sensors, users, rules) are given as a function and read once for every micro-batch, so
edits are seen by the next one and a batch sees one state of them. What later micro-batches or readers need of
earlier ones is folded (``folding``), so no job lists all of a stream's folders. ``compact_readings`` merges finished
days into the fact table.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthlog.operators import alerts, ingest, recent, stats
from hearthlog.schema import READINGS
from hearthlog.session import cut, staging
from hearthlog.sources import files
from hearthlog.sources.sinks import by_day, write_epoch
from hearthlog.streaming import folding

Table = Callable[[], DataFrame]


def start(stream: DataFrame, body, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Run ``body(batch, query id, epoch)`` on every micro-batch."""
    area = "stream-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    # Known once the query has started; the first micro-batch may come before that.
    identity: Future[str] = Future()

    def run(batch: DataFrame, epoch: int) -> None:
        with staging(batch.sparkSession, area):
            body(batch, identity.result(), epoch)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    started = writer.start()
    identity.set_result(str(started.id))
    return started


def stream_ingest(
    requests: DataFrame, sensors: Table, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Classify requests as they arrive; write readings, rejects and each sensor's newest reading.

    The classified rows are staged once, so the feed is read once for all outputs.
    """

    def body(batch: DataFrame, run: str, epoch: int) -> None:
        classified = cut(ingest.classify(batch, sensors()))
        readings = ingest.accepted_readings(classified)
        dated = readings.withColumn("recorded_date", F.to_date("recorded_at"))
        write_epoch(dated, f"{out}/readings", run, epoch, "recorded_date")
        write_epoch(ingest.rejects(classified), f"{out}/rejects", run, epoch, "outcome")
        newest = readings.groupBy("sensor_id").agg(F.max("recorded_at").alias("last_seen_at"))
        write_epoch(newest, f"{out}/last_seen", run, epoch)
        folding.fold(batch.sparkSession, f"{out}/last_seen", _LAST_SEEN, _newest_seen, run, epoch)

    return start(requests, body, checkpoint, available_now)


_FIRED = "rule_id bigint, reading_id bigint, sensor_id bigint, recorded_at timestamp, numeric_value double"
_OUTBOX = f"{_FIRED}, run string, epoch bigint"
_LAST_SEEN = "sensor_id bigint, last_seen_at timestamp"


def _newest_seen(seen: DataFrame) -> DataFrame:
    return seen.groupBy("sensor_id").agg(F.max("last_seen_at").alias("last_seen_at"))


def read_last_seen(spark: SparkSession, out: str) -> DataFrame:
    """Newest accepted reading per sensor over all micro-batches."""
    return _newest_seen(folding.read(spark, f"{out}/last_seen", _LAST_SEEN))


def stream_alerts(
    readings: DataFrame,
    rules: Table,
    users: Table,
    out: str,
    checkpoint: str,
    available_now: bool = False,
    sensors: Table | None = None,
    **sizes: int,
) -> StreamingQuery:
    """Evaluate rules on arriving readings; fired alerts go to the outbox.

    With ``sensors`` the full event records, for whatever sends the messages, are written as well.

    Every micro-batch leaves the last firing of the rules that fired, and these are folded to a row per
    rule, so the outbox is never read; queries with other checkpoints on the same folder are taken in.
    Readings inside a micro-batch are taken in time order; one that is older than the rule's last firing
    is suppressed. ``keyed.stream_cooldown`` keeps the same state in Spark's state store.
    """
    outbox, state = f"{out}/alerts", f"{out}/last_fired"

    def body(batch: DataFrame, run: str, epoch: int) -> None:
        spark = batch.sparkSession
        # One copy of the definitions for matching and for the records, whatever is edited meanwhile.
        current_rules, current_users = cut(rules()), cut(users())
        matches = cut(alerts.alert_matches(batch, current_rules, current_users))
        earlier = folding.read(spark, state, _LAST_FIRED, but=(run, epoch))
        evaluated = cut(alerts.cooldown(_with_last_firing(matches, earlier), **sizes))
        fires = alerts.fired(evaluated)
        write_epoch(fires, outbox, run, epoch)
        write_epoch(_newest_firing(fires), state, run, epoch)
        folding.fold(spark, state, _LAST_FIRED, _newest_firing, run, epoch)
        if sensors is not None:
            events = alerts.alert_events(fires, current_rules, sensors(), current_users)
            write_epoch(events, f"{out}/events", run, epoch)
        write_epoch(alerts.suppressed_counts(evaluated), f"{out}/suppressed", run, epoch)

    return start(readings, body, checkpoint, available_now)


_LAST_FIRED = "rule_id bigint, recorded_at timestamp"


def _newest_firing(fires: DataFrame) -> DataFrame:
    return fires.groupBy("rule_id").agg(F.max("recorded_at").alias("recorded_at"))


def _with_last_firing(matches: DataFrame, earlier: DataFrame) -> DataFrame:
    """Move ``last_triggered_at`` forward to the newest alert of earlier micro-batches."""
    newest = _newest_firing(earlier).withColumnRenamed("recorded_at", "newest")
    return (
        matches.join(newest, "rule_id", "left")
        .withColumn("last_triggered_at", F.greatest("last_triggered_at", "newest"))
        .drop("newest")
    )


def read_outbox(spark: SparkSession, out: str) -> DataFrame:
    """All fired alerts; none before the first micro-batch."""
    if not files.exists(spark, f"{out}/alerts"):
        return spark.createDataFrame([], _FIRED)
    return spark.read.schema(_OUTBOX).parquet(f"{out}/alerts").drop("run", "epoch")


def stream_rollup(
    readings: DataFrame, out: str, checkpoint: str, available_now: bool = False, sensors: Table | None = None
) -> StreamingQuery:
    """Keep 15-minute rollups of arriving readings.

    Each micro-batch adds its own partials; sums and counts merge, so a slot that several
    micro-batches touch is still exact, nothing is ever too late, and no state is held. With ``sensors``
    the readings of those whose zone is off the quarter-hour grid get one-second slots, so the stored
    rollup answers for every zone; without it, all sensors must be on the grid.
    """

    def body(batch: DataFrame, run: str, epoch: int) -> None:
        off_grid = stats.off_grid_sensors(sensors()) if sensors is not None else None
        write_epoch(stats.rollup_15m(batch, off_grid), f"{out}/rollup", run, epoch)
        folding.fold(batch.sparkSession, f"{out}/rollup", _ROLLUP, stats.merge_rollups, run, epoch)

    return start(readings, body, checkpoint, available_now)


_ROLLUP = (
    "sensor_id bigint, unit string, slot_start timestamp, sum_value double, n_values bigint, n_detections bigint"
)


def read_rollup(spark: SparkSession, out: str) -> DataFrame:
    """The rollup so far, ready for the daily and hourly statistics."""
    return stats.merge_rollups(folding.read(spark, f"{out}/rollup", _ROLLUP))


def stream_latest(readings: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the newest readings of every sensor: at most ``RECENT_ROWS`` rows each, whatever arrives.

    The newest of two sets of newest are the newest of all (``recent.merge_latest``), so a micro-batch writes
    its own, limited inside every task before their exchange, and folding merges them. Readings may come
    in any order, and a sensor keeps its rows however long it is silent.
    """

    def body(batch: DataFrame, run: str, epoch: int) -> None:
        write_epoch(recent.merge_latest(batch.select(*READINGS.names)), f"{out}/latest", run, epoch)
        folding.fold(batch.sparkSession, f"{out}/latest", _LATEST, recent.merge_latest, run, epoch)

    return start(readings, body, checkpoint, available_now)


_LATEST = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in READINGS)


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest readings of every sensor that the stream has seen."""
    return recent.merge_latest(folding.read(spark, f"{out}/latest", _LATEST))


def _streamed_days(spark: SparkSession, readings: str, first: dt.date, last: dt.date) -> tuple[list[str], list[str]]:
    """Folders of the streamed days ``first`` to ``last``, and the largest folders that hold nothing else."""
    days, whole = [], []
    inside = lambda name: first.isoformat() <= name.removeprefix("recorded_date=") <= last.isoformat()
    for run in files.children(spark, readings):
        for epoch in files.children(spark, f"{readings}/{run}") if run.startswith("run=") else ():
            folder = f"{readings}/{run}/{epoch}"
            there = [name for name in files.children(spark, folder) if name.startswith("recorded_date=")]
            found = [f"{folder}/{name}" for name in there if inside(name)]
            days += found
            whole += [folder] if found and len(found) == len(there) else found
    return days, whole


def compact_readings(
    spark: SparkSession, out: str, fact: str, first: dt.date, last: dt.date, deleted: DataFrame | None = None
) -> None:
    """Merge the streamed readings of the days ``first`` to ``last`` into the fact table at ``fact``.

    A day of the fact table keeps the readings it has; a reading that it has already, or that several
    queries have delivered, is kept once. Readings of the sensors in ``deleted`` (column ``id``) are left
    out, so that a deleted sensor does not come back with its late readings. The files of a day are
    exchanged for clustered ones and the streamed folders removed in one recoverable step, after which a
    second run finds nothing to do. Give days that no feed adds to any more; should one be added to after
    all, the next run merges those readings as well.
    """
    files.recover(spark, fact)
    days, whole = _streamed_days(spark, f"{out}/readings", first, last)
    if not days:
        return
    layout = f"{_LATEST}, recorded_date date"
    streamed = spark.read.schema(layout).option("basePath", f"{out}/readings").parquet(*days)
    rows = streamed.select(*READINGS.names).dropDuplicates(["id"])
    replaced = files.files_of(spark, fact, sorted({day.rsplit("/", 1)[1] for day in days}))
    if replaced:
        stored = spark.read.schema(layout).option("basePath", fact).parquet(*[f"{fact}/{name}" for name in replaced])
        stored = stored.select(*READINGS.names)
        rows = stored.unionByName(rows.join(stored.select("id"), "id", "left_anti"))
    if deleted is not None:
        rows = rows.join(deleted.select(F.col("id").alias("sensor_id")), "sensor_id", "left_anti").select(*READINGS.names)
    files.exchange(spark, fact, by_day(rows), replaced, whole)
