"""Streams give what the batch jobs give, however the feed is cut, and survive a restart."""

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import alerts, ingest, stats
from hearthlog.sources import driver_tables
from hearthlog.sources.requests import stream_requests
from hearthlog.schema import READINGS
from hearthlog.streaming import jobs
from tests.conftest import SMALL, at


def in_files(df, order, parts, path):
    """Write ``df`` as ``parts`` files, earlier rows in earlier files."""
    bounds = df.approxQuantile(order, [n / parts for n in range(1, parts)], 0.0)
    edges = [float("-inf"), *bounds, float("inf")]
    for low, high in zip(edges, edges[1:]):
        df.where((F.col(order) > low) & (F.col(order) <= high)).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, layout, path):
    return spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def readings_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed") / "readings")
    in_files(driver_tables.readings(spark, SMALL), "id", 4, path)
    return path


def same(left, right):
    right = right.select(*left.columns)
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_ingest_equals_batch(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    requests, sensors = driver_tables.requests(spark, SMALL), driver_tables.sensors(spark, SMALL)
    in_files(requests, "request_id", 3, feed)
    run = jobs.stream_ingest(
        stream_requests(spark, feed, max_files_per_trigger=1), lambda: sensors, out, str(tmp_path / "cp"), available_now=True
    )
    run.awaitTermination()
    batch = ingest.classify(requests, sensors)
    accepted = ingest.accepted_readings(batch)
    written = spark.read.parquet(f"{out}/readings")
    assert written.select("epoch").distinct().count() == 3
    assert same(accepted, written) and same(ingest.rejects(batch), spark.read.parquet(f"{out}/rejects"))
    newest = accepted.groupBy("sensor_id").agg(F.max("recorded_at").alias("last_seen_at"))
    assert same(newest, jobs.read_last_seen(spark, out))


def start_alerts(spark, path, out, checkpoint, **sizes):
    rules, users = driver_tables.rules(spark, SMALL), driver_tables.users(spark, SMALL)
    sensors = driver_tables.sensors(spark, SMALL)
    return jobs.stream_alerts(
        stream_of(spark, READINGS, path), lambda: rules, lambda: users, out, checkpoint, available_now=True,
        sensors=lambda: sensors, **sizes,
    )


def batch_alerts(spark):
    return alerts.fired(
        alerts.evaluate_alerts(*(getattr(driver_tables, n)(spark, SMALL) for n in ("readings", "rules", "users")))
    )


def test_alerts_equal_batch(spark, readings_path, tmp_path):
    out = str(tmp_path / "out")
    start_alerts(spark, readings_path, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{out}/alerts").select("epoch").distinct().count() > 1
    fires = batch_alerts(spark)
    assert same(fires, jobs.read_outbox(spark, out))
    tables = [getattr(driver_tables, n)(spark, SMALL) for n in ("rules", "sensors", "users")]
    flat = lambda df: df.select("rule_id", "reading_id", "recipient.email", "sensor.name", "trigger.threshold_value")
    assert same(flat(alerts.alert_events(fires, *tables)), flat(spark.read.parquet(f"{out}/events")))


def test_alerts_resume_and_replay(spark, tmp_path):
    feed, out, checkpoint = (str(tmp_path / name) for name in ("feed", "out", "cp"))
    readings = driver_tables.readings(spark, SMALL)
    readings.where("id < 500").coalesce(1).write.parquet(feed)
    start_alerts(spark, feed, out, checkpoint).awaitTermination()
    first = jobs.read_outbox(spark, out).count()
    readings.where("id >= 500").coalesce(1).write.mode("append").parquet(feed)
    start_alerts(spark, feed, out, checkpoint).awaitTermination()
    assert 0 < first < 72 and same(batch_alerts(spark), jobs.read_outbox(spark, out))
    # A second run from a fresh checkpoint replays the same epochs over the same folders.
    start_alerts(spark, feed, out, str(tmp_path / "cp2")).awaitTermination()
    assert same(batch_alerts(spark), jobs.read_outbox(spark, out))


def test_rollup_equals_batch(spark, readings_path, tmp_path):
    out = str(tmp_path / "out")
    jobs.stream_rollup(stream_of(spark, READINGS, readings_path), out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    settle = lambda df: df.withColumn("sum_value", F.round("sum_value", 6))
    stored = jobs.read_rollup(spark, out)
    assert same(settle(stats.rollup_15m(driver_tables.readings(spark, SMALL))), settle(stored))
    bounded = stats.slots_around(stored, driver_tables.AS_OF)
    assert "PushedFilters: [IsNotNull(slot_start), GreaterThanOrEqual(slot_start" in bounded._jdf.queryExecution().executedPlan().toString()
    sensors = driver_tables.sensors(spark, SMALL)
    rounded = lambda df: df.withColumn("value", F.round("value", 6))
    direct = stats.daily_statistics(driver_tables.readings(spark, SMALL), sensors, driver_tables.AS_OF)
    assert same(rounded(direct), rounded(stats.daily_from_rollup(bounded, sensors, driver_tables.AS_OF)))


def test_stored_rollup_is_exact_off_the_grid(spark, tmp_path):
    """10 and 30 fall on two local days at +01:07; a quarter-hour slot would mix them."""
    out, feed = str(tmp_path / "out"), str(tmp_path / "feed")
    rows = [(1, 1, 10.0, None, "C", at("2024-01-29 22:52:59")), (2, 1, 30.0, None, "C", at("2024-01-29 22:53:00"))]
    spark.createDataFrame(rows, READINGS).write.parquet(feed)
    known = driver_tables.sensors(spark, SMALL).where("id = 1").withColumn("time_zone_id", F.lit("+01:07"))
    known = known.withColumn("type", F.lit("TEMPERATURE"))
    jobs.stream_rollup(
        stream_of(spark, READINGS, feed), out, str(tmp_path / "cp"), available_now=True, sensors=lambda: known
    ).awaitTermination()
    got = {
        str(r.local_date): r.value
        for r in stats.daily_from_rollup(jobs.read_rollup(spark, out), known, at("2024-01-30 12:00:00")).collect()
    }
    assert (got["2024-01-29"], got["2024-01-30"]) == (10.0, 30.0)


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    """Two queries with other checkpoints over other feeds: no row of any sink disappears."""
    out = str(tmp_path / "out")
    requests, sensors = driver_tables.requests(spark, SMALL), driver_tables.sensors(spark, SMALL)
    for part, half in (("a", "request_id < 500"), ("b", "request_id >= 500")):
        feed = str(tmp_path / f"feed-{part}")
        requests.where(half).coalesce(1).write.parquet(feed)
        jobs.stream_ingest(
            stream_requests(spark, feed), lambda: sensors, out, str(tmp_path / f"cp-{part}"), available_now=True
        ).awaitTermination()
    batch = ingest.classify(requests, sensors)
    assert same(ingest.accepted_readings(batch), spark.read.parquet(f"{out}/readings"))
    assert same(ingest.rejects(batch), spark.read.parquet(f"{out}/rejects"))


def test_a_cooldown_longer_than_a_week_holds_across_batches(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    rules = driver_tables.rules(spark, SMALL).where("enabled AND rule_type = 'NUMERIC_THRESHOLD'").limit(1)
    rules = rules.withColumns({"cooldown_minutes": F.lit(20160), "threshold_value": F.lit(0.0), "comparison_operator": F.lit("ABOVE")})
    rules = spark.createDataFrame(rules.collect(), rules.schema)
    users = driver_tables.users(spark, SMALL).withColumn("email_verified_at", F.lit(at("2023-12-02 00:00:00")))
    rule = rules.first()
    for n, day in ((1, "2024-01-01"), (2, "2024-01-10"), (3, "2024-01-20")):
        row = (n, rule.sensor_id, 50.0, None, rule.threshold_unit, at(f"{day} 12:00:00"))
        spark.createDataFrame([row], READINGS).coalesce(1).write.mode("append").parquet(feed)
        jobs.stream_alerts(
            stream_of(spark, READINGS, feed), lambda: rules, lambda: users, out, str(tmp_path / "cp"), available_now=True
        ).awaitTermination()
    assert sorted(r.reading_id for r in jobs.read_outbox(spark, out).collect()) == [1, 3]
