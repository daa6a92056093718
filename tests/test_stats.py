"""Local-time statistics: gaps, daylight saving, off-grid zones, and agreement of the shapes."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import labels, recent, stats
from hearthlog.sources import driver_tables
from hearthlog.sources.sinks import hourly_json
from tests.conftest import SMALL, at

READING = "id bigint, sensor_id bigint, numeric_value double, boolean_value boolean, unit string, recorded_at timestamp"
SENSOR = "id bigint, owner_id bigint, type string, home_location string, time_zone_id string"
USER = "id bigint, preferred_temperature_unit string, preferred_language string"


def sensors(spark, *rows):
    return spark.createDataFrame([(i, 1, kind, "Hall", zone) for i, kind, zone in rows], SENSOR)


def readings(spark, *rows):
    full = []
    for i, (sensor, value, unit, text) in enumerate(rows):
        flag = isinstance(value, bool)
        full.append((i, sensor, None if flag else value, value if flag else None, unit, at(text)))
    return spark.createDataFrame(full, READING)


def hourly(df):
    return {(r.sensor_id, r.hour): r.value for r in df.collect() if r.value is not None}


def test_repeated_hour_is_one_bucket(spark):
    data = readings(spark, (1, 10.0, "C", "2024-11-03 05:30:00"), (1, 20.0, "C", "2024-11-03 06:30:00"))
    got = stats.hourly_statistics(data, sensors(spark, (1, "TEMPERATURE", "America/New_York")), at("2024-11-03 12:00:00"))
    assert got.count() == 24 and hourly(got) == {(1, 1): 15.0}


def test_skipped_hour_is_a_gap(spark):
    data = readings(
        spark, (1, 1.0, "C", "2024-03-10 06:59:59"), (1, 3.0, "C", "2024-03-10 07:00:00"),
        (1, 9.0, "C", "2024-03-11 03:59:59"), (1, 8.0, "C", "2024-03-11 04:00:00"),
    )
    got = stats.hourly_statistics(
        data, sensors(spark, (1, "TEMPERATURE", "America/New_York")), at("2024-06-01 00:00:00"), dt.date(2024, 3, 10)
    )
    assert got.count() == 24 and hourly(got) == {(1, 1): 1.0, (1, 3): 3.0, (1, 23): 9.0}


def test_days_follow_the_sensor_zone(spark):
    data = readings(
        spark, (1, 1.0, "C", "2024-01-29 18:14:59"), (1, 2.0, "C", "2024-01-29 18:15:00"),
        (2, 5.0, "C", "2024-01-29 18:15:00"),
    )
    known = sensors(spark, (1, "TEMPERATURE", "Asia/Kathmandu"), (2, "TEMPERATURE", "UTC"))
    got = stats.daily_statistics(data, known, at("2024-01-30 12:00:00"))
    values = {(r.sensor_id, str(r.local_date)): r.value for r in got.collect()}
    assert len(values) == 14
    assert values[1, "2024-01-29"] == 1.0 and values[1, "2024-01-30"] == 2.0 and values[2, "2024-01-29"] == 5.0
    assert values[1, "2024-01-24"] is None


def test_only_canonical_units_and_true_flags_count(spark):
    data = readings(
        spark, (1, 50.0, "PERCENT", "2024-01-30 01:00:00"), (1, 90.0, "C", "2024-01-30 01:00:00"),
        (2, True, None, "2024-01-30 01:00:00"), (2, False, None, "2024-01-30 01:00:00"), (2, True, None, "2024-01-30 23:59:59"),
    )
    known = sensors(spark, (1, "HUMIDITY", "UTC"), (2, "MOTION", "UTC"), (3, "MOTION", "UTC"), (4, "HUMIDITY", "UTC"))
    got = {(r.sensor_id, str(r.local_date)): r.value for r in stats.daily_statistics(data, known, at("2024-01-30 12:00:00")).collect()}
    today = "2024-01-30"
    assert (got[1, today], got[2, today], got[3, today], got[4, today]) == (50.0, 2.0, 0.0, None)


def test_off_grid_zone_is_exact(spark):
    data = readings(
        spark, (1, 1.0, "C", "2024-01-29 22:52:29.999999"), (1, 2.0, "C", "2024-01-29 22:52:30"),
        (2, 3.0, "C", "2024-01-29 22:52:30"),
    )
    known = sensors(spark, (1, "TEMPERATURE", "+01:07:30"), (2, "TEMPERATURE", "UTC"))
    got = {(r.sensor_id, str(r.local_date)): r.value for r in stats.daily_statistics(data, known, at("2024-01-30 12:00:00")).collect()}
    assert (got[1, "2024-01-29"], got[1, "2024-01-30"], got[2, "2024-01-29"]) == (1.0, 2.0, 3.0)
    assert stats.off_grid_sensors(sensors(spark, (1, "MOTION", "UTC"))) is None
    half_hour = readings(spark, (1, 4.0, "C", "2024-01-30 01:52:29.999999"), (1, 6.0, "C", "2024-01-30 01:52:30"))
    assert hourly(stats.hourly_statistics(half_hour, known, at("2024-01-30 12:00:00"))) == {(1, 2): 4.0, (1, 3): 6.0}


def test_old_offsets_are_exact(spark):
    data = readings(spark, (1, 1.0, "C", "1971-12-31 00:44:29.999999"), (1, 2.0, "C", "1971-12-31 00:44:30"))
    known = sensors(spark, (1, "TEMPERATURE", "Africa/Monrovia"))
    got = {str(r.local_date): r.value for r in stats.daily_statistics(data, known, at("1971-12-31 12:00:00")).collect()}
    assert (got["1971-12-30"], got["1971-12-31"]) == (1.0, 2.0)


def test_kiritimati_before_1979_is_exact(spark):
    data = readings(spark, (1, 10.0, "C", "1975-06-01 10:39:59"), (1, 30.0, "C", "1975-06-01 10:40:00"))
    known = sensors(spark, (1, "TEMPERATURE", "Pacific/Kiritimati"))
    got = {str(r.local_date): r.value for r in stats.daily_statistics(data, known, at("1975-06-02 12:00:00")).collect()}
    assert (got["1975-05-31"], got["1975-06-01"]) == (10.0, 30.0)


def test_unusable_zone_is_quarantined(spark):
    known = sensors(spark, (1, "MOTION", "Mars/Olympus"), (2, "MOTION", "UTC"))
    data = readings(spark, (1, True, None, "2024-01-30 01:00:00"), (2, True, None, "2024-01-30 01:00:00"))
    got = stats.daily_statistics(data, known, at("2024-01-30 12:00:00"))
    assert {r.sensor_id for r in got.collect()} == {2}
    assert [r.sensor_id for r in stats.unusable_zones(known).collect()] == [1]


def test_against_plain_python(spark):
    """Every cell of the fixture recomputed row by row from zoneinfo."""
    as_of = driver_tables.AS_OF
    known = {r.id: r for r in driver_tables.sensors(spark, SMALL).collect()}
    sums = {}
    for r in driver_tables.readings(spark, SMALL).collect():
        sensor = known[r.sensor_id]
        local = r.recorded_at.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(sensor.time_zone_id))
        if sensor.type == "MOTION" and not r.boolean_value:
            continue
        for key in ((r.sensor_id, local.date()), (r.sensor_id, local.date(), local.hour)):
            total, n = sums.get(key, (0.0, 0))
            sums[key] = (total + (r.numeric_value or 0.0), n + 1)

    def want(sensor, key):
        total, n = sums.get(key, (0.0, 0))
        return float(n) if sensor.type == "MOTION" else (total / n if n else None)

    data, table = driver_tables.readings(spark, SMALL), driver_tables.sensors(spark, SMALL)
    daily = stats.daily_statistics(data, table, as_of).collect()
    assert len(daily) == 105 and sum(r.value is not None for r in daily) == 81
    for r in daily:
        assert r.value == pytest.approx(want(known[r.sensor_id], (r.sensor_id, r.local_date)))
    hours = stats.hourly_statistics(data, table, as_of).collect()
    assert len(hours) == 15 * 24
    for r in hours:
        assert r.value == pytest.approx(want(known[r.sensor_id], (r.sensor_id, r.local_date, r.hour)))


def test_rollups_merge(spark):
    data, table = driver_tables.readings(spark, SMALL), driver_tables.sensors(spark, SMALL)
    first, second = data.where("id % 2 = 0"), data.where("id % 2 = 1")
    merged = stats.merge_rollups(stats.rollup_15m(first), stats.rollup_15m(second))
    direct = stats.daily_statistics(data, table, driver_tables.AS_OF)
    through = stats.daily_from_rollup(merged, table, driver_tables.AS_OF)
    settle = lambda df: df.withColumn("value", F.round("value", 6))
    assert settle(direct).exceptAll(settle(through)).count() == 0


def test_nested_shape(spark):
    known = sensors(spark, (1, "TEMPERATURE", "UTC"), (2, "HUMIDITY", "UTC"), (3, "MOTION", "UTC"))
    data = readings(spark, (1, 10.0, "C", "2024-01-30 05:00:00"), (1, 20.0, "C", "2024-01-30 05:30:00"), (3, True, None, "2024-01-25 05:00:00"))
    users = spark.createDataFrame([(1, "FAHRENHEIT", "ENGLISH")], USER)
    nested = stats.nested_statistics(data, known, users, at("2024-01-30 12:00:00"))
    rows = {r.sensor_id: r for r in nested.collect()}
    assert rows[1].unit_symbol == "°F" and rows[1].weekly[-1].value == 59.0 and rows[1].hourly[5].value == 59.0
    assert rows[3].weekly[1].value == 1.0 and [p.hour for p in rows[3].hourly] == list(range(24))
    checks = nested.select(
        "sensor_id", stats.series_shape_ok(F.col("weekly"), F.col("hourly")).alias("ok"),
        stats.has_data(F.col("sensor_type"), F.col("hourly")).alias("data"),
    )
    assert {r.sensor_id: (r.ok, r.data) for r in checks.collect()} == {1: (True, True), 2: (True, False), 3: (True, True)}
    broken = nested.select(stats.series_shape_ok(F.slice("weekly", 1, 6), F.col("hourly")).alias("ok"))
    assert {r.ok for r in broken.collect()} == {False}


def test_hourly_json(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 0, 2.5)], "s int, h int, v double")
    row = df.groupBy("s").agg(hourly_json(F.col("h"), F.col("v")).alias("j")).first()
    assert row.j == '[{"hour":0,"value":2.5},{"hour":1,"value":null}]'


def test_latest_breaks_ties_by_id(spark):
    same = [(i, 1, 1.0, None, "C", at("2024-01-30 01:00:00")) for i in range(12)]
    got = recent.latest(spark.createDataFrame(same, READING)).select("id", "position").collect()
    assert sorted((r.position, r.id) for r in got) == [(n + 1, 11 - n) for n in range(10)]
    plan = recent.latest(spark.createDataFrame(same, READING))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


def test_series_dates_stop_at_local_today(spark):
    known = sensors(spark, (1, "MOTION", "Australia/Lord_Howe"), (2, "MOTION", "UTC"))
    dates = spark.createDataFrame(
        [(s, dt.date(2024, 1, day)) for s in (1, 2) for day in (30, 31)], "sensor_id bigint, date date"
    )
    got = stats.allowed_dates(dates, known, at("2024-01-30 14:00:00")).collect()
    assert {(r.sensor_id, r.date.day) for r in got} == {(1, 30), (1, 31), (2, 30)}


def test_table_is_in_the_readers_language(spark):
    data = readings(spark, (1, 1.5, "C", "2024-01-30 01:00:00"), (2, 1.5, "C", "2024-01-30 01:00:00"))
    known = sensors(spark, (1, "TEMPERATURE", "UTC"), (2, "TEMPERATURE", "UTC"), (3, "TEMPERATURE", "UTC"))
    users = spark.createDataFrame([], "id bigint, preferred_temperature_unit string")
    nested = stats.nested_statistics(data, known, users, at("2024-01-30 12:00:00"))
    languages = spark.createDataFrame([(1, "ENGLISH"), (2, "TURKISH")], "sensor_id bigint, language string")
    rows = labels.statistics_table(nested, languages=languages).collect()
    shown = {r.sensor_id: r.label for r in rows if r.position == "2024-01-30"}
    assert shown.keys() == {1, 2} and shown[1] != shown[2]
    assert len([r for r in rows if r.sensor_id == 1]) == 31
