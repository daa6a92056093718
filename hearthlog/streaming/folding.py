"""Tables that a stream adds a folder to per micro-batch, and that stay short.

Every micro-batch writes mergeable rows under ``run=.../epoch=...`` (``sinks.write_epoch``). Once ``EVERY`` of
these folders are there they are merged into one part of level 1, ``EVERY`` parts of a level into one of the next.
A reader lists at most ``EVERY`` folders per level, and there are logarithmically many levels, so neither listing nor
the work per row grows with the age of the stream.

A part counts once its note is there. The note names the folders the part was made of: until they are
deleted, readers leave them out. A crash at any point therefore loses and doubles nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthlog.sources import files

_NOTE = "_made_of.json"
# Folders of one level that are merged into one of the next.
EVERY = 16


def _epochs(spark: SparkSession, path: str) -> list[str]:
    """Folders of finished micro-batches, as paths below ``path``."""
    found = []
    for run in files.children(spark, path):
        if run.startswith("run="):
            epochs = [f"{run}/{name}" for name in files.children(spark, f"{path}/{run}") if name.startswith("epoch=")]
            found += [epoch for epoch in epochs if files.exists(spark, f"{path}/{epoch}/_SUCCESS")]
    return found


def _parts(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Complete parts, and what each was made of."""
    found = {}
    for level in files.children(spark, f"{path}/folded"):
        for name in files.children(spark, f"{path}/folded/{level}"):
            part = f"folded/{level}/{name}"
            note = files.read_note(spark, f"{path}/{part}/{_NOTE}")
            if note is not None:
                found[part] = note["made_of"]
    return found


def _live(spark: SparkSession, path: str) -> list[str]:
    parts = _parts(spark, path)
    used = {source for sources in parts.values() for source in sources}
    return [folder for folder in [*_epochs(spark, path), *parts] if folder not in used]


def _rows(spark: SparkSession, path: str, layout: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], layout)
    return spark.read.schema(layout).parquet(*[f"{path}/{folder}" for folder in folders])


def read(spark: SparkSession, path: str, layout: str, but: tuple[str, int] | None = None) -> DataFrame:
    """All rows that count; those of the micro-batch ``but`` (run, epoch) are left out."""
    own = f"run={but[0]}/epoch={but[1]}" if but else None
    return _rows(spark, path, layout, [folder for folder in _live(spark, path) if folder != own])


def fold(
    spark: SparkSession,
    path: str,
    layout: str,
    merge: Callable[[DataFrame], DataFrame],
    run: str,
    epoch: int,
    every: int = EVERY,
) -> int:
    """Merge what has gathered; returns the number of parts made.

    Call it from the micro-batch ``epoch`` of ``run``: a micro-batch may be written again until the next one
    starts, so its own folder is left alone. Only one query at a time may fold a table.
    """
    for sources in _parts(spark, path).values():
        for source in sources:
            files.remove(spark, f"{path}/{source}")
    live, made, level = _live(spark, path), 0, 0
    while True:
        if level:
            ready = [folder for folder in live if folder.startswith(f"folded/level={level}/")]
        else:
            # Later folders of this run exist only where an earlier attempt was cut off.
            own = lambda f: f.startswith(f"run={run}/") and int(f.rsplit("=", 1)[1]) >= epoch
            ready = [folder for folder in live if folder.startswith("run=") and not own(folder)]
        if len(ready) < every:
            if level and not any(f.startswith(f"folded/level={level + 1}/") for f in live):
                return made
            level += 1
            continue
        part = f"folded/level={level + 1}/part={uuid.uuid4().hex}"
        merge(_rows(spark, path, layout, ready)).write.parquet(f"{path}/{part}")
        files.write_note(spark, f"{path}/{part}/{_NOTE}", {"made_of": ready})
        for source in ready:
            files.remove(spark, f"{path}/{source}")
        live = [folder for folder in live if folder not in ready] + [part]
        made += 1
        level += 1
