"""At most ``limit`` events per key and anchored window.

A key's window opens at its first event, lasts ``width`` and admits its first ``limit`` events;
events beyond them neither count nor extend it. The next window opens at the first event at or
after the end. With ``limit = 1`` this is a cooldown: each admitted event blocks the ones that
follow for ``width``. Where a window opens depends on all windows before it, so this is not an SQL
window; events are taken in (time, id) order per key.

Two plans give the same rows:

* ``_sequential`` hash-partitions by key, sorts, and walks each key once with constant state.
* ``_striped`` is for a key with more events than one task should walk. Time is cut into cells of
  exactly one width. Between neighbouring cells the position inside the cell can only grow, until
  the cell has nothing further up and the chain restarts at the bottom of a later cell. Ranges of
  that position ("stripes") are therefore independent: a chain always enters a stripe at its lower
  edge, whatever happened before. Each stripe works out, for every cell, in which cell a chain that
  enters there leaves it again. Those hops are folded over groups of neighbouring stripes, level by
  level, until one short list per key remains; the true chain is walked there, expanded level by
  level, and a second pass over the stripes turns the visited entries into opening events. Stripes
  are sampled ranges, so they are balanced however the key's events are spread, and no task holds
  more than one stripe of events or one group of hops.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog.functions import text
from hearthlog.session import cut

# Send the task functions below with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The sizes below choose between plans; the flags do not depend on them.
# A key with more events than this is split into stripes.
HOT_KEY_EVENTS = 20_000_000
# Target events per stripe; one stripe is held in memory as two long columns.
STRIPE_EVENTS = 2_000_000

# Stripes (or groups of stripes) folded into one group per level, and the most hops (members times
# cells) a task holds for it; long histories of short windows get smaller groups.
FAN_OUT = 64
GROUP_HOPS = 4_000_000

# Fixed value: key used for a missing or blank key.
UNKNOWN_KEY = "[unknown]"

_T, _W, _N, _SEED = "__t", "__w", "__n", "__seed"


def cap_per_window(
    events: DataFrame,
    key: str,
    time: str,
    event_id: str,
    width_minutes: Column | int,
    limit: int,
    flag: str = "allowed",
    last_admitted: Column | None = None,
    hot_key_events: int = HOT_KEY_EVENTS,
    stripe_events: int = STRIPE_EVENTS,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """``events`` plus a boolean ``flag``: admitted by the cap of its key.

    ``last_admitted`` names, per row of a key, the instant at which the key's latest window opened
    before these events; that window counts as used up. ``width_minutes`` and ``last_admitted`` are
    constant within a key; key, time and id are never NULL, and an id occurs once per key.

    The events are written once to the shared folder: they are counted per key first, and the
    source is not scanned again for the walk.
    """
    width = F.lit(width_minutes) if isinstance(width_minutes, int) else width_minutes
    seed = F.lit(None).cast("timestamp") if last_admitted is None else last_admitted
    staged = cut(
        events.withColumn(_T, F.unix_micros(time))
        .withColumn(_W, width.cast("long") * F.lit(60_000_000))
        .withColumn(_N, F.lit(limit).cast("long"))
        .withColumn(_SEED, F.unix_micros(seed) + width.cast("long") * F.lit(60_000_000))
    )
    hot = (
        staged.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("__events"),
            F.max(_W).alias(_W),
            F.greatest(F.max(_SEED), F.min(_T)).alias("__origin"),
            F.max(_T).alias("__newest"),
        )
        .where(F.col("__events") > hot_key_events)
        .withColumn("__cells", (F.col("__newest") - F.col("__origin")) / F.col(_W))
    )
    found = hot.agg(
        F.count(F.lit(1)).alias("keys"), F.sum("__events").alias("events"), F.max("__cells").alias("cells")
    ).first()
    helper = (_T, _W, _N, _SEED)
    if found["keys"] == 0:
        return _sequential(staged, key, event_id, flag).drop(*helper)
    # At most events / hot_key_events keys can be hot, so this table is small by construction.
    hot_keys = F.broadcast(hot.select(key, "__origin").transform(cut))
    stripes = max(2, math.ceil(found["events"] / stripe_events))
    fan_out = max(2, min(fan_out, int(GROUP_HOPS / max(1, found["cells"]))))
    cold = _sequential(staged.join(hot_keys, key, "left_anti"), key, event_id, flag)
    busy = _striped(staged.join(hot_keys, key), key, event_id, limit, stripes, fan_out, flag)
    return cold.unionByName(busy.select(*cold.columns)).drop(*helper)


def normalized_key(value: Column) -> Column:
    """Trimmed key; missing and blank keys share one."""
    return F.coalesce(text.required_text(value), F.lit(UNKNOWN_KEY))


def cap_two_keys(
    events: DataFrame,
    address: str,
    client: str,
    time: str,
    event_id: str,
    address_limit: int,
    client_limit: int,
    width_minutes: int,
    **sizes: int,
) -> DataFrame:
    """Admit an event only if the caps of its address and of its client both do.

    Both caps are consumed whichever of them refuses. Only id, time and keys are staged and walked; other
    columns of the events are joined to the flags at the end.
    """
    keyed = events.withColumn(address, normalized_key(F.col(address))).withColumn(
        client, normalized_key(F.col(client))
    )
    narrow = (event_id, time, address, client)
    once = cap_per_window(
        keyed.select(*narrow), address, time, event_id, width_minutes, address_limit, flag="address_allowed", **sizes
    )
    both = cap_per_window(
        once, client, time, event_id, width_minutes, client_limit, flag="client_allowed", **sizes
    )
    flags = both.withColumn("allowed", F.col("address_allowed") & F.col("client_allowed"))
    if set(events.columns) == set(narrow):
        return flags
    # An id occurs once per address, so the join keeps every event once.
    return keyed.join(flags.drop(time, client), [event_id, address])


# --- one walk per key -----------------------------------------------------------------------------


def _sequential(staged: DataFrame, key: str, event_id: str, flag: str) -> DataFrame:
    ordered = staged.repartition(key).sortWithinPartitions(key, _T, event_id)
    layout = T.StructType(staged.schema.fields + [T.StructField(flag, T.BooleanType(), False)])
    return ordered.mapInArrow(lambda batches: _walk(batches, key, flag), layout)


def _walk(batches: Iterator[pa.RecordBatch], key: str, flag: str) -> Iterator[pa.RecordBatch]:
    """Flag sorted batches; a key that spans batches carries (window end, events used)."""
    current, end, used = None, 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key)
        codes = pc.dictionary_encode(keys).indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1, [batch.num_rows]))
        times, widths, limits = (batch.column(name).to_numpy(zero_copy_only=False) for name in (_T, _W, _N))
        seeds = batch.column(_SEED)
        admitted = np.zeros(batch.num_rows, dtype=bool)
        for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
            name, width, limit = keys[start].as_py(), int(widths[start]), int(limits[start])
            if name != current:
                seed = seeds[start].as_py()
                current, end, used = name, (times[start] if seed is None else seed), limit
            position = start
            while position < stop:
                inside = position + int(np.searchsorted(times[position:stop], end, side="left"))
                take = min(limit - used, inside - position)
                admitted[position : position + take] = True
                used += take
                position = inside
                if position < stop:
                    end, used = int(times[position]) + width, 0
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(admitted)], names=[*batch.schema.names, flag]
        )


# --- stripes for hot keys -------------------------------------------------------------------------


def _striped(
    hot_events: DataFrame, key: str, event_id: str, limit: int, stripes: int, fan_out: int, flag: str
) -> DataFrame:
    """Flag the events of hot keys; ``hot_events`` carries each key's ``__origin``.

    Events before the origin lie in the seeded window and are refused.
    """
    elapsed = F.col(_T) - F.col("__origin")
    placed = hot_events.withColumn("__offset", F.pmod(elapsed, F.col(_W))).withColumn(
        "__cell", ((elapsed - F.col("__offset")) / F.col(_W)).cast("long")
    )
    first_ids = (
        placed.where(F.col("__cell") >= 0)
        .groupBy(key, "__cell", "__offset")
        .agg(F.min(event_id).alias("__first"))
        .select(F.col(key).alias("k"), F.col("__cell").alias("cell"), F.col("__offset").alias("pos"), "__first")
    )
    # The partition a row lands in is its stripe; writing it down keeps both passes on the same one.
    striped = cut(
        first_ids.repartitionByRange(stripes, "k", "pos").withColumn("stripe", F.spark_partition_id())
    )
    grid = striped.select("k", F.col("stripe").cast("long").alias("stripe"), "cell", "pos")
    layout = lambda *names: T.StructType(
        [striped.schema["k"]] + [T.StructField(name, T.LongType()) for name in names]
    )
    hops = cut(grid.groupBy("k", "stripe").applyInPandas(_hops, layout("stripe", "cell", "leaves")))
    visited = _visited(hops, stripes, fan_out, layout)
    opening_layout = layout("cell", "pos")
    openings = cut(
        grid.groupBy("k", "stripe")
        .cogroup(visited.groupBy("k", "stripe"))
        .applyInPandas(_openings, opening_layout)
    )
    if limit == 1:
        admitted = openings.join(striped, ["k", "cell", "pos"]).select(
            F.col("k").alias(key), F.col("__first").alias(event_id)
        )
    else:
        admitted = _first_of_windows(placed, openings, key, event_id, limit)
    return (
        hot_events.join(admitted.withColumn(flag, F.lit(True)), [key, event_id], "left")
        .withColumn(flag, F.coalesce(flag, F.lit(False)))
        .drop("__origin")
    )


def _visited(hops: DataFrame, stripes: int, fan_out: int, layout) -> DataFrame:
    """(key, stripe, cell) entries of the true chain of every hot key."""
    levels, members = [hops], stripes
    while members > fan_out:
        grouped = levels[-1].withColumn("group", F.floor(F.col("stripe") / fan_out).cast("long"))
        levels[-1] = grouped
        levels.append(
            grouped.groupBy("k", "group").applyInPandas(
                lambda rows: _fold(rows, fan_out), layout("stripe", "cell", "leaves")
            )
        )
        members = math.ceil(members / fan_out)
    visited = levels[-1].groupBy("k").applyInPandas(_chain, layout("stripe", "cell"))
    for lower in reversed(levels[:-1]):
        entered = visited.withColumnRenamed("stripe", "group")
        visited = (
            lower.groupBy("k", "group")
            .cogroup(entered.groupBy("k", "group"))
            .applyInPandas(lambda rows, at: _expand(rows, at, fan_out), layout("stripe", "cell"))
        )
    return visited


def _first_of_windows(
    placed: DataFrame, openings: DataFrame, key: str, event_id: str, limit: int
) -> DataFrame:
    """First ``limit`` events of every window.

    A cell holds at most one opening. An event belongs to the opening of its own cell when that
    lies at or before it, else to the opening of the cell before. Row numbers are limited inside
    each task before the exchange, so a dense window costs ``limit`` rows per task.
    """
    own = openings.select(F.col("k").alias(key), F.col("cell").alias("__cell"), F.col("pos").alias("__own"))
    before = openings.select(
        F.col("k").alias(key), (F.col("cell") + 1).alias("__cell"), F.lit(True).alias("__before")
    )
    window_cell = F.when(F.col("__own") <= F.col("__offset"), F.col("__cell")).otherwise(F.col("__cell") - 1)
    in_order = Window.partitionBy(key, "__window").orderBy(_T, event_id)
    return (
        placed.where(F.col("__cell") >= 0)
        .select(key, event_id, _T, "__cell", "__offset")
        .join(own, [key, "__cell"], "left")
        .join(before, [key, "__cell"], "left")
        .where((F.col("__own") <= F.col("__offset")) | F.col("__before"))
        .withColumn("__window", window_cell)
        .withColumn("__rank", F.row_number().over(in_order))
        .where(F.col("__rank") <= limit)
        .select(key, event_id)
    )


def _of_key(rows: pd.DataFrame, **columns) -> pd.DataFrame:
    """Result rows of the one key in ``rows``."""
    size = len(next(iter(columns.values())))
    key = rows["k"].iloc[0] if len(rows) else None
    return pd.DataFrame({"k": pd.Series([key] * size, dtype=object), **columns})


def _cells(stripe: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    """(cell, ascending positions) of one stripe, cells ascending."""
    cell, pos = stripe["cell"].to_numpy(), stripe["pos"].to_numpy()
    order = np.lexsort((pos, cell))
    cell, pos = cell[order], pos[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1))
    return list(zip(cell[starts].tolist(), np.split(pos, starts[1:])))


def _hops(stripe: pd.DataFrame) -> pd.DataFrame:
    """For each cell, the cell in which a chain that enters there leaves the stripe upwards.

    Going backwards, an opening at position p leaves where the next cell's first opening at or
    above p does; when the next cell has none, it leaves there.
    """
    rows, after_cell, after_pos, after_leaves = [], None, None, None
    for cell, pos in reversed(_cells(stripe)):
        leaves = np.full(len(pos), cell + 1, dtype=np.int64)
        if after_cell == cell + 1:
            successor = np.searchsorted(after_pos, pos, side="left")
            linked = successor < len(after_pos)
            leaves[linked] = after_leaves[successor[linked]]
        rows.append((cell, leaves[0]))
        after_cell, after_pos, after_leaves = cell, pos, leaves
    cells, exits = zip(*rows)
    return _of_key(stripe, stripe=[stripe["stripe"].iloc[0]] * len(cells), cell=cells, leaves=exits)


def _chain(hops: pd.DataFrame) -> pd.DataFrame:
    """Entries the true chain visits, from the bottom of cell 0 upwards.

    (cell, stripe) pairs are numbered in order; a chain that leaves a stripe goes on at the next
    number, which past the last stripe is the bottom of the next cell.
    """
    width = int(hops["stripe"].max()) + 1
    code = hops["cell"].to_numpy() * width + hops["stripe"].to_numpy()
    order = np.argsort(code)
    code = code[order]
    follow = (hops["leaves"].to_numpy() * width + hops["stripe"].to_numpy() + 1)[order]
    successor = np.searchsorted(code, follow, side="left").tolist()
    visited, at = [], 0
    while at < len(code):
        visited.append(at)
        at = successor[at]
    kept = hops.iloc[order[visited]]
    return _of_key(hops, stripe=kept["stripe"].to_numpy(), cell=kept["cell"].to_numpy())


def _links(hops: pd.DataFrame, fan_out: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Hops of one group in (cell, member) order, their codes, and the hop that follows each.

    A hop is followed inside the group only in the very cell it leaves in; -1 means that the chain
    leaves the group there.
    """
    member = hops["stripe"].to_numpy() % fan_out
    code = hops["cell"].to_numpy() * fan_out + member
    order = np.argsort(code)
    hops, code = hops.iloc[order], code[order]
    leaves = hops["leaves"].to_numpy()
    follow = np.searchsorted(code, leaves * fan_out + member[order] + 1, side="left")
    inside = follow < len(code)
    inside[inside] = code[follow[inside]] < (leaves[inside] + 1) * fan_out
    return hops, code, np.where(inside, follow, -1)


def _fold(hops: pd.DataFrame, fan_out: int) -> pd.DataFrame:
    """Hops of a group of stripes from the hops of its members."""
    hops, code, follow = _links(hops, fan_out)
    leaves = hops["leaves"].to_numpy().copy()
    for index in range(len(leaves) - 1, -1, -1):
        if follow[index] >= 0:
            leaves[index] = leaves[follow[index]]
    cell, first = np.unique(code // fan_out, return_index=True)
    return _of_key(hops, stripe=[hops["group"].iloc[0]] * len(cell), cell=cell, leaves=leaves[first])


def _expand(hops: pd.DataFrame, entered: pd.DataFrame, fan_out: int) -> pd.DataFrame:
    """Member entries of a group, given the cells in which the chain enters the group."""
    if hops.empty or entered.empty:
        return _of_key(hops, stripe=[], cell=[])
    hops, code, follow = _links(hops, fan_out)
    visited = []
    for index in np.searchsorted(code, entered["cell"].to_numpy() * fan_out, side="left").tolist():
        while index >= 0:
            visited.append(index)
            index = int(follow[index])
    kept = hops.iloc[visited]
    return _of_key(hops, stripe=kept["stripe"].to_numpy(), cell=kept["cell"].to_numpy())


def _openings(stripe: pd.DataFrame, visited: pd.DataFrame) -> pd.DataFrame:
    """Opening events of one stripe, given the cells in which the chain enters it."""
    entries = set(visited["cell"].tolist())
    found_cell, found_pos, at_cell, at_pos = [], [], None, None
    for cell, pos in _cells(stripe) if entries else ():
        if cell in entries:
            index = 0
        elif at_cell is not None and cell == at_cell + 1:
            index = int(np.searchsorted(pos, at_pos, side="left"))
        else:
            index = len(pos)
        if index < len(pos):
            at_cell, at_pos = cell, int(pos[index])
            found_cell.append(at_cell)
            found_pos.append(at_pos)
        else:
            at_cell = None
    return _of_key(stripe, cell=found_cell, pos=found_pos)
