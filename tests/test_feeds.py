"""The request log source and the alert sink."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthlog.sources import alert_sink, request_log
from hearthlog.sources.alert_sink import Written


def read_all(path, size):
    parts = request_log._Reader({"path": str(path), "rangebytes": str(size)}).partitions()
    return [line for p in parts for batch in request_log.lines(p) for line in batch.column("line").to_pylist()]


@pytest.mark.parametrize("block", [3, 16, 1 << 20])
@pytest.mark.parametrize("size", [1, 2, 5, 17, 1000])
def test_every_line_is_read_once_whatever_the_ranges(tmp_path, monkeypatch, size, block):
    monkeypatch.setattr(request_log, "_BLOCK", block)
    rng = random.Random(size)
    want = []
    for name in ("a.log", "b.log", "c.log"):
        lines = ["x" * rng.randrange(12) + rng.choice(["", "ä", "漢"]) for _ in range(rng.randrange(20))]
        (tmp_path / name).write_text("".join(f"{line}\n" for line in lines) + ("tail" if name == "b.log" else ""))
        want += lines + (["tail"] if name == "b.log" else [])
    assert read_all(tmp_path, size) == want


def test_offsets_stop_at_whole_lines(tmp_path):
    reader = request_log._StreamReader({"path": str(tmp_path), "rangebytes": "4"})
    assert reader.latestOffset() == reader.initialOffset()
    (tmp_path / "a").write_text("one\ntwo\nthr")
    first = reader.latestOffset()
    assert first == {"file": "a", "bytes": 8}
    (tmp_path / "a").write_text("one\ntwo\nthree\n")
    (tmp_path / "b").write_text("four\nfi")
    (tmp_path / "c").write_text("six")
    second = reader.latestOffset()
    assert second == {"file": "b", "bytes": 5}
    taken = lambda s, e: [x for p in reader.partitions(s, e) for b in reader.read(p) for x in b.column("line").to_pylist()]
    assert taken(reader.initialOffset(), first) == ["one", "two"]
    assert taken(first, second) == ["three", "four"]


def test_log_lines_are_parsed(spark, tmp_path):
    lines = ["7\t2024-01-01T10:00:00.000001Z\t/readings\tsensorToken=a&celsiusValue=1", "x\tnever\t/p", "", "8\t2024-01-01T10:00:00Z\t/p\ta\tb"]
    (tmp_path / "log").write_text("\n".join(lines))
    at = dt.datetime(2024, 1, 1, 10)
    got = request_log.read_request_log(spark, str(tmp_path)).orderBy("request_id").collect()
    assert [tuple(r) for r in got] == [
        (None, None, "/p", None),
        (7, at.replace(microsecond=1), "/readings", "sensorToken=a&celsiusValue=1"),
        (8, at, "/p", "a\tb"),
    ]


def test_a_growing_log_is_tailed_across_restarts(spark, tmp_path):
    log, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    log.mkdir()
    for text in ("1\t2024-01-01T00:00:00Z\t/a\tx\n2\t2024-", "01-01T00:00:00Z\t/a\ty\n", "3\t2024-01-01T00:00:00Z\t/a\tz\n"):
        with open(log / "one.log", "a") as file:
            file.write(text)
        stream = request_log.stream_request_log(spark, str(log), range_bytes=8)
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.request_id, r.body) for r in spark.read.parquet(out).collect()) == [(1, "x"), (2, "y"), (3, "z")]


ROW = {"rule_id": [1], "reading_id": [2], "sensor_id": [3], "recorded_at": [dt.datetime(2024, 1, 1)], "numeric_value": [1.5]}


def test_sink_commits_aborts_and_replays(spark, tmp_path):
    path = str(tmp_path / "alerts")
    writer = alert_sink._Writer(path)
    batch = lambda n: iter([pa.record_batch({**ROW, "reading_id": [n]})])
    ids = lambda: sorted(r.reading_id for r in alert_sink.read_alert_sink(spark, path).collect())
    writer.commit([writer.write(batch(1)), writer.write(iter(())), None], 0)
    assert ids() == [1]
    # An aborted micro-batch and a task whose message was lost leave nothing to read.
    writer.abort([writer.write(batch(2)), None], 1)
    writer.write(batch(3))
    assert ids() == [1]
    # A replay after the commit adds nothing; one after half a commit replaces it.
    writer.commit([writer.write(batch(4))], 0)
    half = writer.write(batch(5))
    with pytest.raises(FileNotFoundError):
        writer.commit([half, Written("lost.parquet")], 1)
    writer.commit([writer.write(batch(6))], 1)
    assert ids() == [1, 6]


def test_a_failed_task_leaves_no_row_and_a_retry_one(spark, tmp_path):
    feed, out, checkpoint = (str(tmp_path / n) for n in ("feed", "out", "cp"))
    spark.range(20).select(
        F.col("id").alias("rule_id"), F.col("id").alias("reading_id"), F.lit(1).cast("long").alias("sensor_id"),
        F.timestamp_seconds("id").alias("recorded_at"), F.lit(1.0).alias("numeric_value"),
    ).repartition(4).write.parquet(feed)
    stream = spark.readStream.schema(alert_sink.ALERTS).parquet(feed)
    fails = F.when(F.col("rule_id") == 7, F.raise_error(F.lit("task fails")).cast("double")).otherwise(F.col("numeric_value"))
    failing = alert_sink.write_alert_stream(stream.withColumn("numeric_value", fails), out, checkpoint, available_now=True)
    with pytest.raises(Exception, match="task fails"):
        failing.awaitTermination()
    assert not [p for p in tmp_path.glob("out/batch=*/*.parquet")]
    alert_sink.write_alert_stream(stream, out, checkpoint, available_now=True).awaitTermination()
    assert sorted(r.rule_id for r in alert_sink.read_alert_sink(spark, out).collect()) == list(range(20))
