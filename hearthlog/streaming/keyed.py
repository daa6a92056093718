"""Streams that keep a row of state per key in Spark's state store.

``CapState`` is the anchored window of ``operators.throttle`` as a keyed operator: a key's state is the instant
at which its window opened and how many events it has admitted, whatever the number of events. A cooldown is the
case of one event per window. The state lives in the checkpoint, so a restarted query goes on where it stopped,
and no output of earlier micro-batches is read.

Events of a micro-batch are taken in (time, id) order per key. A key's events of one micro-batch are held as two
columns of numbers by its task; admission control of the source (files or offsets per trigger) bounds them. An event
older than its key's window counts into that window: it is admitted if the window has room and never moves it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from hearthlog.operators import alerts, throttle
from hearthlog.session import KEYED_STATE
from hearthlog.sources.sinks import write_epoch
from hearthlog.streaming.jobs import start

# Send the processors with the query, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MINUTE = 60_000_000
# Columns of the operator's own; Spark renames columns of such rows that start with an underscore.
_T, _W, _SEED = "at_micros", "width_micros", "seed_micros"


def admit(times: np.ndarray, width: int, limit: int, anchor: int | None, used: int) -> tuple[np.ndarray, int | None, int]:
    """Which of the sorted ``times`` are admitted, and the window (anchor, used) they leave open."""
    flags = np.zeros(len(times), dtype=bool)
    at = 0
    while at < len(times):
        if anchor is None or times[at] >= anchor + width:
            anchor, used = int(times[at]), 0
        # All events before the window's end belong to it; the next one opens another.
        end = int(np.searchsorted(times, anchor + width, side="left"))
        room = min(limit - used, end - at)
        if room > 0:
            flags[at : at + room] = True
            used += room
        at = end
    return flags, anchor, used


class CapState(StatefulProcessor):
    """At most ``limit`` events per key and window; adds ``flag`` to the rows of ``columns``.

    With ``expires`` the state of a key leaves the store once the watermark has passed the window's end:
    an event from then on opens a new window with or without it.
    """

    def __init__(self, columns: list[str], event_id: str, limit: int, flag: str, expires: bool) -> None:
        self.columns, self.event_id, self.limit, self.flag, self.expires = columns, event_id, limit, flag, expires

    def init(self, handle) -> None:
        self._handle = handle
        self._window = handle.getValueState("window", "anchor bigint, used bigint, ends_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True).sort_values([_T, self.event_id], kind="stable")
        width, seed = int(events[_W].iloc[0]), events[_SEED].max()
        anchor, used, ends = self._window.get() if self._window.exists() else (None, 0, None)
        if not pd.isna(seed) and (anchor is None or seed > anchor):
            anchor, used = int(seed), self.limit
        flags, anchor, used = admit(events[_T].to_numpy(dtype=np.int64), width, self.limit, anchor, used)
        new_end = -((anchor + width) // -1000)
        if self.expires and new_end != ends:
            if ends is not None:
                self._handle.deleteTimer(ends)
            self._handle.registerTimer(new_end)
        self._window.update((anchor, used, new_end))
        yield events[self.columns].assign(**{self.flag: flags})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._window.exists() and self._window.get()[2] <= timerValues.getCurrentWatermarkInMs():
            self._window.clear()
        return iter(())

    def close(self) -> None:
        pass


def cap_per_window(
    events: DataFrame,
    key: str,
    time: str,
    event_id: str,
    width_minutes: Column | int,
    limit: int,
    flag: str = "allowed",
    last_admitted: Column | None = None,
    expires: bool = True,
) -> DataFrame:
    """The streaming twin of ``throttle.cap_per_window``: ``events`` plus a boolean ``flag``.

    ``expires`` needs a watermark on the feed. Late events are not dropped: those later than the watermark
    are judged by what state is left.
    """
    width = F.lit(width_minutes) if isinstance(width_minutes, int) else width_minutes
    seed = F.lit(None).cast("timestamp") if last_admitted is None else last_admitted
    keyed = events.withColumns(
        {_T: F.unix_micros(time), _W: width.cast("long") * F.lit(_MINUTE), _SEED: F.unix_micros(seed)}
    )
    # The time travels as a number: Spark would drop late rows of a watermarked column.
    plain = keyed.drop(time)
    columns = [c for c in plain.columns if c not in (_W, _SEED)]
    layout = T.StructType([*(plain.schema[c] for c in columns), T.StructField(flag, T.BooleanType())])
    judged = plain.groupBy(key).transformWithStateInPandas(
        CapState(columns, event_id, limit, flag, expires), layout, "Append", "EventTime" if expires else "None"
    )
    order = [F.timestamp_micros(_T).alias(c) if c == time else F.col(c) for c in events.columns]
    return judged.select(*order, flag)


def cap_two_keys(
    events: DataFrame,
    address: str,
    client: str,
    time: str,
    event_id: str,
    address_limit: int,
    client_limit: int,
    width_minutes: int,
) -> DataFrame:
    """The streaming twin of ``throttle.cap_two_keys``: one keyed state behind the other.

    Both caps see every event, so both are consumed whatever the other decides.
    """
    keyed = events.withColumns({k: throttle.normalized_key(F.col(k)) for k in (address, client)})
    first = cap_per_window(keyed, address, time, event_id, width_minutes, address_limit, "address_allowed")
    both = cap_per_window(first, client, time, event_id, width_minutes, client_limit, "client_allowed")
    return both.withColumn("allowed", F.col("address_allowed") & F.col("client_allowed"))


def _needs_keyed_state(df: DataFrame) -> None:
    for name, value in KEYED_STATE.items():
        df.sparkSession.conf.set(name, value)


def cooldown(readings: DataFrame, rules: DataFrame, users: DataFrame) -> DataFrame:
    """The streaming twin of ``alerts.evaluate_alerts``: matches of arriving readings with ``fired``."""
    _needs_keyed_state(readings)
    return cap_per_window(
        alerts.alert_matches(readings, rules, users),
        "rule_id",
        "recorded_at",
        "reading_id",
        F.col("cooldown_minutes"),
        1,
        "fired",
        last_admitted=F.col("last_triggered_at"),
        expires=False,
    )


def stream_cooldown(
    readings: DataFrame, rules: DataFrame, users: DataFrame, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Evaluate rules on arriving readings with each rule's last firing as keyed state.

    Fired alerts go to ``alerts`` and the number of suppressed matches per rule to ``suppressed``, a folder
    per micro-batch. A rule without state starts from its ``last_triggered_at``, rules added later
    included. ``rules`` and ``users`` are read with the query's plan: restart it to see edits; the state stays.
    """
    evaluated = cooldown(readings, rules, users)

    def body(batch: DataFrame, run: str, epoch: int) -> None:
        batch.persist()
        write_epoch(alerts.fired(batch), f"{out}/alerts", run, epoch)
        write_epoch(alerts.suppressed_counts(batch), f"{out}/suppressed", run, epoch)
        batch.unpersist()

    return start(evaluated, body, checkpoint, available_now)


_VERDICTS = (
    "id bigint, requested_at timestamp, address_key string, client_key string, address_allowed boolean, "
    "client_allowed boolean, allowed boolean"
)


def read_verdicts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_VERDICTS).parquet(f"{out}/verdicts").drop("run", "epoch")


def stream_caps(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    *,
    address_limit: int,
    client_limit: int,
    width_minutes: int,
    lateness: str = "1 hour",
    available_now: bool = False,
) -> StreamingQuery:
    """Judge requests (id, requested_at, address_key, client_key) as they arrive; verdicts go to ``verdicts``.

    Windows that ended before the newest request less ``lateness`` leave the state store.
    """
    _needs_keyed_state(requests)
    judged = cap_two_keys(
        requests.withWatermark("requested_at", lateness),
        "address_key",
        "client_key",
        "requested_at",
        "id",
        address_limit,
        client_limit,
        width_minutes,
    )

    def body(batch: DataFrame, run: str, epoch: int) -> None:
        write_epoch(batch, f"{out}/verdicts", run, epoch)

    return start(judged, body, checkpoint, available_now)
