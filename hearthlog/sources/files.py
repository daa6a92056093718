"""Replacing files of a Parquet table so that a crash leaves it whole.

A job that changes a few files of a large table writes the new rows aside, says in a small file beside the table
what is to be exchanged, and exchanges it. Each step can be repeated: whoever finds that file finishes the exchange
first (``recover``). Rows are written by Spark's tasks; the driver handles file names only.

All paths go through the file system that Spark itself uses for them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrameWriter, SparkSession

# Names that start with an underscore are not part of a table for Spark.
_MARKER = "_exchange.json"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _system(spark, path).listStatus(_path(spark, path)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens if it is gone already."""
    _system(spark, path).delete(_path(spark, path), True)


def write_note(spark: SparkSession, path: str, content: dict) -> None:
    """Write a small file under its final name only when it is complete."""
    system, aside = _system(spark, path), f"{path}.{uuid.uuid4().hex}"
    stream = system.create(_path(spark, aside), True)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    system.delete(_path(spark, path), False)
    system.rename(_path(spark, aside), _path(spark, path))


def read_note(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _folders(spark: SparkSession, table: str) -> list[str]:
    return [name for name in children(spark, table) if "=" in name]


def files_of(spark: SparkSession, table: str, folders: Iterable[str]) -> list[str]:
    """The data files in some partition folders of ``table``, as paths below it."""
    found = []
    for folder in folders:
        names = children(spark, f"{table}/{folder}")
        found += [f"{folder}/{name}" for name in names if not name.startswith(("_", "."))]
    return found


def exchange(
    spark: SparkSession, table: str, new: DataFrameWriter | None, gone: Iterable[str], after: Iterable[str] = ()
) -> int:
    """Put the rows of ``new`` in place of the files ``gone`` of ``table``; returns how many files came in.

    ``new`` writes partition folders; its rows may come from the files that go. ``gone`` are paths below
    ``table``. The folders ``after`` are deleted as the last step: they hold what ``new`` has taken in.
    While files are exchanged a reader may see rows twice.
    """
    recover(spark, table)
    aside = f"{table}/_aside-{uuid.uuid4().hex}"
    arriving = []
    if new is not None:
        new.parquet(aside)
        arriving = files_of(spark, aside, _folders(spark, aside))
    note = {"aside": aside, "new": arriving, "gone": sorted(gone), "after": sorted(after)}
    write_note(spark, f"{table}/{_MARKER}", note)
    recover(spark, table)
    return len(arriving)


def recover(spark: SparkSession, table: str) -> None:
    """Finish an exchange that was begun; every step may have been taken before."""
    note = read_note(spark, f"{table}/{_MARKER}")
    if note is None:
        return
    system = _system(spark, table)
    for name in note["new"]:
        source, target = f"{note['aside']}/{name}", f"{table}/{name}"
        if exists(spark, source):
            system.mkdirs(_path(spark, target).getParent())
            system.rename(_path(spark, source), _path(spark, target))
    for name in note["gone"]:
        remove(spark, f"{table}/{name}")
    for folder in sorted({name.rsplit("/", 1)[0] for name in note["gone"]}):
        if not files_of(spark, table, [folder]):
            remove(spark, f"{table}/{folder}")
    for path in note["after"]:
        remove(spark, path)
    remove(spark, note["aside"])
    remove(spark, f"{table}/{_MARKER}")
    spark.catalog.refreshByPath(table)
