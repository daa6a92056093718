"""Key filters and stored series."""

import random

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import key_filter, recent, stats
from hearthlog.schema import READINGS
from hearthlog.sources import bucketed, driver_tables
from hearthlog.streaming import series
from tests.conftest import SMALL, at
from tests.test_streaming import same, stream_of


@pytest.mark.parametrize("bits", [1, 7, 40_000, 1 << 40])
def test_taken_keys_and_missing_references_are_exact(spark, bits):
    rng = random.Random(bits)
    stored = [(n, f"k{rng.randrange(300)}") for n in range(200)] + [(900, None)]
    batch = [(1000 + n, f"k{rng.randrange(600)}") for n in range(150)] + [(2000, None), (2001, None), (2002, "")]
    old, new = (spark.createDataFrame(rows, "id bigint, name string") for rows in (stored, batch))
    keys = [k for _, k in batch if k is not None]
    want = sorted(i for i, k in batch if k is not None and (keys.count(k) > 1 or k in {s for _, s in stored}))
    known = key_filter.merge(*(key_filter.build(old.where(half), F.col("name"), bits) for half in ("id % 2 = 0", "id % 2 = 1")))
    got = key_filter.taken_keys(new, old, F.col("name"), known, bits)
    assert sorted(r.id for r in got.collect()) == want and got.columns == ["id", "name", "key_value"]
    children = [(n, rng.choice([None, rng.randrange(400)])) for n in range(100)]
    child = spark.createDataFrame(children, "id bigint, parent bigint")
    parents = key_filter.build(old, F.col("id"), bits)
    missing = key_filter.missing_references(child, old, "parent", parents, bits)
    assert sorted(map(tuple, missing.collect())) == sorted((i, p) for i, p in children if p is not None and p >= 200)


def test_a_clean_batch_leaves_the_table_unread(spark):
    old = spark.range(1000).select("id")
    known = key_filter.build(old, F.col("id"))
    unreadable = old.select(F.raise_error(F.lit("the table was scanned")).cast("bigint").alias("id"))
    clean = spark.range(5000, 5100).select("id")
    assert key_filter.taken_keys(clean, unreadable, F.col("id"), known).count() == 0
    rows = clean.select(F.col("id"), F.col("id").alias("parent"))
    assert key_filter.missing_references(rows, unreadable, "parent", known).count() == 100
    # One in ten at most is compared at the intended filling of a filter.
    small = key_filter.build(old, F.col("id"), bits=10_000)
    through = key_filter.marked(spark.range(10**6, 10**6 + 5000), F.col("id"), small, 10_000).where("may_be_stored").count()
    assert 300 < through < 650


def test_stored_series_follow_late_readings(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    readings, sensors = driver_tables.readings(spark, SMALL), driver_tables.sensors(spark, SMALL)
    for part in range(3):
        readings.where(f"(id * 7 + id DIV 3) % 3 = {part}").write.mode("append").parquet(feed)
        run = series.stream_series(stream_of(spark, READINGS, feed), lambda: sensors, out, str(tmp_path / "cp"), True)
        run.awaitTermination()
    rounded = lambda df: df.withColumn("value", F.round("value", 6))
    for as_of in (driver_tables.AS_OF, at("2024-01-12 23:30:00")):
        assert same(rounded(stats.daily_statistics(readings, sensors, as_of)), rounded(series.daily_series(spark, out, sensors, as_of)))
        assert same(rounded(stats.hourly_statistics(readings, sensors, as_of)), rounded(series.hourly_series(spark, out, sensors, as_of)))
    date = at("2024-01-20 00:00:00").date()
    cells = stats.hourly_from_cells(series.read_cells(spark, out), sensors, driver_tables.AS_OF, date)
    assert same(rounded(stats.hourly_statistics(readings, sensors, driver_tables.AS_OF, date)), rounded(cells))


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    readings = bucketed.write_readings(driver_tables.readings(spark, SMALL), "bucketed_r", str(tmp_path / "r"), 4)
    sensors = bucketed.write_sensors(driver_tables.sensors(spark, SMALL), "bucketed_s", str(tmp_path / "s"), 4)
    of_sensor = sensors.select(F.col("id").alias("sensor_id"), "owner_id", "type")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for setting in names:
        spark.conf.set(setting, "-1")
    try:
        for df in (stats.rollup_15m(readings), recent.latest(readings).join(of_sensor, "sensor_id"), readings.join(of_sensor, "sensor_id")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
        rollup = stats.rollup_15m(driver_tables.readings(spark, SMALL))
        assert same(rollup.select("sensor_id", "slot_start", "n_values"), stats.rollup_15m(readings).select("sensor_id", "slot_start", "n_values"))
    finally:
        for setting in names:
            spark.conf.unset(setting)
        spark.sql("DROP TABLE bucketed_r")
        spark.sql("DROP TABLE bucketed_s")


def test_a_sensor_too_heavy_for_a_bucket_is_refused(spark, tmp_path):
    readings = driver_tables.readings(spark, SMALL)
    assert bucketed.heaviest_sensor(readings) > 50 and bucketed.heaviest_sensor(readings.limit(0)) == 0
    with pytest.raises(ValueError, match="more than one bucket"):
        bucketed.write_readings(readings, "bucketed_x", str(tmp_path / "x"), 4, most=50)
