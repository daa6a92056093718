"""Growing logs of form-encoded reading requests, as a Spark data source.

A folder holds log files whose names sort in the order they were begun; new lines are appended to the last ones.
A line is ``request id, time of arrival, path, body``, divided by tabs; a form-encoded body holds none. Spark's text
source reads a file once and misses what is appended later; this one keeps a position instead: the newest file with
bytes taken and how many of them, all earlier files being complete. Files are cut into byte ranges, so a large
file is read by many tasks; a line belongs to the range in which it starts. A line still being written is left for
the next micro-batch.

Rows cross from Python as Arrow batches of raw lines and are parsed by Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 32 << 20
_BLOCK = 1 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _logs(path: str) -> list[tuple[str, int]]:
    """(name, size) of the log files in a folder, in the order they were begun."""
    system, folder = _system(path)
    found = system.get_file_info(fs.FileSelector(folder))
    logs = [(f.base_name, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
    return sorted(logs)


def _whole_lines(path: str, name: str, size: int, after: int) -> int:
    """The end of the last complete line of a file, at least ``after``."""
    system, folder = _system(path)
    with system.open_input_file(f"{folder}/{name}") as file:
        end = size
        while end > after:
            start = max(after, end - _BLOCK)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return after


def _ranges(path: str, name: str, start: int, end: int, size: int) -> list[ByteRange]:
    return [ByteRange(f"{path}/{name}", at, min(at + size, end)) for at in range(start, end, size)]


def lines(part: ByteRange) -> Iterator[pa.RecordBatch]:
    """The lines that start in a range, in batches of about a block."""
    system, path = _system(part.path)
    with system.open_input_file(path) as file:
        size, at = file.size(), part.start
        if at:
            # The line that runs into the range belongs to the one before.
            at -= 1
            while at < size:
                block = file.read_at(min(_BLOCK, size - at), at)
                found = block.find(b"\n")
                if found >= 0:
                    at += found + 1
                    break
                at += len(block)
        rest = b""
        while at < part.end or rest:
            block = file.read_at(min(_BLOCK, size - at), at) if at < size else b""
            # Past the end of the range only the line begun before it is finished.
            inside = max(0, part.end - at)
            at += len(block)
            if not block or inside < len(block):
                stop = block.find(b"\n", max(0, inside - 1))
                text, rest = rest + (block if stop < 0 else block[: stop + 1]), b""
                if block and stop < 0 and at < size:
                    rest = text
                    continue
                yield from _batch(text)
                return
            text = rest + block
            cut = text.rfind(b"\n") + 1
            text, rest = text[:cut], text[cut:]
            yield from _batch(text)
            if at >= part.end and not rest:
                return


def _batch(text: bytes) -> Iterator[pa.RecordBatch]:
    if text:
        body = pa.array([text.removesuffix(b"\n").decode("utf-8", "replace")])
        yield pa.record_batch([pc.list_flatten(pc.split_pattern(body, "\n"))], names=["line"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        return [r for name, size in _logs(self.path) for r in _ranges(self.path, name, 0, size, self.size)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return lines(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {file, bytes}: files before ``file`` are complete, of ``file`` so many bytes are taken."""

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"file": "", "bytes": 0}

    def latestOffset(self) -> dict:
        logs = _logs(self.path)
        for name, size in reversed(logs):
            end = _whole_lines(self.path, name, size, 0)
            if end:
                return {"file": name, "bytes": end}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        found = []
        for name, size in _logs(self.path):
            if start["file"] <= name <= end["file"]:
                first = start["bytes"] if name == start["file"] else 0
                last = end["bytes"] if name == end["file"] else size
                found += _ranges(self.path, name, first, last, self.size)
        return found

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return lines(partition)


class RequestLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "request_log"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def log_line(request_id: Column, received_at: Column, path: Column, body: Column) -> Column:
    """A request as a line of the log."""
    at = F.date_format(received_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat_ws("\t", request_id.cast("string"), at, path, body)


def parsed(log: DataFrame) -> DataFrame:
    """Requests from lines; parts that cannot be read are NULL, and a body may be missing."""
    part = lambda i: F.try_element_at(F.split("line", "\t", 4), F.lit(i))
    return log.where(F.length("line") > 0).select(
        part(1).try_cast("bigint").alias("request_id"),
        part(2).try_cast("timestamp").alias("received_at"),
        part(3).alias("path"),
        part(4).alias("body"),
    )


def read_request_log(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All requests in the logs of a folder."""
    spark.dataSource.register(RequestLog)
    return parsed(spark.read.format("request_log").option("rangeBytes", range_bytes).load(path))


def stream_request_log(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Requests as they are appended to the logs of a folder."""
    spark.dataSource.register(RequestLog)
    return parsed(spark.readStream.format("request_log").option("rangeBytes", range_bytes).load(path))
