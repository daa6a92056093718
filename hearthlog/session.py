"""Session settings every job relies on, and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count

from pyspark.sql import DataFrame, SparkSession

# Run-time settings that change results or plans; nothing here depends on the size of the cluster.
_RUNTIME = {
    # Instants are stored in UTC; sensor-local time is always computed from a zone column.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One sensor may own a third of the rows: split its join partition even when the split
    # costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# What queries with keyed state need; they set it when they start.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

# Settings a session can only be started with.
_AT_START = {
    # Recording the Python call site of every column costs more than building the plans here.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for name, value in _RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def bound_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bound the bytes of the Arrow batches that Python tasks get; a row is never cut.

    Spark bounds rows only, and ten thousand long texts or sets are more than a task should hold.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def build_session(app_name: str = "hearthlog", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session; ``conf`` takes Spark settings with dots written as ``__``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**_RUNTIME, **_AT_START}.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return configure(builder.getOrCreate())


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder, because its executors share the driver's disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    folder = tempfile.mkdtemp(prefix="hearthlog-")
    context.setCheckpointDir(folder)
    return folder


# Inside ``staging``: the folder of the running micro-batch and a counter of its staged tables.
_AREA: ContextVar[tuple[str, Iterator[int]] | None] = ContextVar("staging area", default=None)


@contextmanager
def staging(spark: SparkSession, name: str) -> Iterator[None]:
    """Let ``cut`` reuse the same folders every time a block of this ``name`` runs.

    A stream stages rows in every micro-batch; with a name of its own it overwrites those of the
    batch before, which is finished by then, instead of filling the shared folder.
    """
    token = _AREA.set((f"{scratch_dir(spark)}/{name}", count()))
    try:
        yield
    finally:
        _AREA.reset(token)


# Folders that ``cut`` has written outside ``staging``, by application.
_STAGED: dict[str, list[str]] = {}


def discard_staged(spark: SparkSession) -> int:
    """Delete what batch jobs of this session have staged; returns the number of folders.

    Call it when the jobs' results have been written: a result that has not been computed yet may still read
    from them.
    """
    folders = _STAGED.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where several passes need the same rows: the source is scanned once, every pass sees
    identical rows and reads only the columns it needs, and a lost executor costs a re-read rather
    than a re-computation. Spark also knows the true size of the table from then on, which is what
    it bases its choice of joins on. ``options`` are the writer's.
    """
    spark, area = df.sparkSession, _AREA.get()
    if area is None:
        path = f"{scratch_dir(spark)}/staged-{uuid.uuid4().hex}"
        _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    else:
        path = f"{area[0]}/staged-{next(area[1])}"
    df.write.mode("overwrite").options(**options).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def release(spark: SparkSession, *staged: DataFrame) -> None:
    """Give back the disk of steps that are over: these results of ``cut``, and files of finished exchanges.

    For jobs in rounds. Nothing that is still to be computed may read the tables. Spark deletes the files of an
    exchange once the driver has collected the plan that made it, which by itself may take half an hour.
    """
    for df in staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()
