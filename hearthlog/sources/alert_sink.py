"""A streaming sink for fired alerts that commits per micro-batch.

Tasks write their rows as Parquet files to a folder that readers do not look into and report the names. When all
tasks of a micro-batch are done, the driver moves the files into the micro-batch's own folder and marks it. A task that
fails or runs twice thus leaves no row, an aborted micro-batch none, and one that is replayed after its commit adds
none. Sending is left to whoever reads the folder; a failure there does not touch the alerts.

The file system is the one of the path's scheme; tasks and driver must both reach it.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALERTS = "rule_id bigint, reading_id bigint, sensor_id bigint, recorded_at timestamp, numeric_value double"


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def _system(self) -> tuple[fs.FileSystem, str]:
        path = self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = self._system()
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if writer is None:
                system.create_dir(f"{path}/_arriving")
                writer = pq.ParquetWriter(f"{path}/_arriving/{name}", batch.schema, filesystem=system)
            writer.write_batch(batch)
        if writer is None:
            return Written(None)
        writer.close()
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, path = self._system()
        folder = f"{path}/batch={batchId}"
        if system.get_file_info(f"{folder}/_SUCCESS").type == fs.FileType.File:
            # Committed before: this is a replay.
            self.abort(messages, batchId)
            return
        # What an interrupted commit has moved so far is written again by the replay.
        system.create_dir(folder)
        system.delete_dir_contents(folder)
        for message in messages:
            if message is not None and message.name:
                system.move(f"{path}/_arriving/{message.name}", f"{folder}/{message.name}")
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        system, path = self._system()
        for message in messages:
            if message is not None and message.name:
                system.delete_file(f"{path}/_arriving/{message.name}")


class AlertSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alert_sink"

    def schema(self) -> str:
        return ALERTS

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_alert_stream(fires: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Send a stream of fired alerts to the folder ``path``."""
    fires.sparkSession.dataSource.register(AlertSink)
    writer = fires.writeStream.format("alert_sink").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_alert_sink(spark: SparkSession, path: str) -> DataFrame:
    """The committed alerts."""
    return spark.read.schema(ALERTS).parquet(path).drop("batch")
