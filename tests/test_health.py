"""Invariants, uniqueness, references, rule loading, retention, deletes and lists."""

import datetime as dt

from pyspark.sql import functions as F

from hearthlog.operators import quality, recent, retention
from hearthlog.sources import driver_tables
from hearthlog.schema import READINGS
from tests.conftest import SMALL, at

OLD = at("2024-01-01 00:00:00")


def broken(df, checks):
    return {(r.row_id, r.rule) for r in quality.violations(df, "t", checks).collect()}


def test_reading_invariants(spark):
    rows = [
        (1, 1.0, None, "C"), (2, None, True, None), (3, None, None, None), (4, 1.0, True, "C"), (5, 1.0, None, None),
        (6, 1.0, None, "F"), (7, float("nan"), None, "C"), (8, -300.0, None, "C"), (9, 100.5, None, "PERCENT"),
        (10, float("-inf"), None, "C"), (11, None, True, "C"),
    ]
    df = spark.createDataFrame(rows, "id bigint, numeric_value double, boolean_value boolean, unit string")
    assert broken(df, quality.reading_checks()) == {
        (3, "value_shape"), (4, "value_shape"), (5, "value_shape"), (6, "unit_known"), (7, "numeric_finite"),
        (8, "temperature_range"), (9, "humidity_range"), (10, "numeric_finite"), (10, "temperature_range"),
        (11, "value_shape"),
    }


def test_rule_invariants(spark):
    ok = (1, "NUMERIC_THRESHOLD", "ABOVE", 1.0, "C", None, 60)
    rows = [
        ok, (2, "EVENT_DETECTED", None, None, None, "MOTION_DETECTED", 1), (3, "OTHER", "ABOVE", 1.0, "C", None, 60),
        (4, "NUMERIC_THRESHOLD", "EQUAL", 1.0, "C", None, 60), (5, "NUMERIC_THRESHOLD", "ABOVE", 1.0, " ", None, 60),
        (6, "EVENT_DETECTED", "ABOVE", None, None, "MOTION_DETECTED", 60), (7, "NUMERIC_THRESHOLD", "ABOVE", 1.0, "C", None, 0),
        (8, "NUMERIC_THRESHOLD", "ABOVE", 1.0, "C", None, 10081), (9, "EVENT_DETECTED", None, None, None, "DOOR", 60),
        (10, "NUMERIC_THRESHOLD", "ABOVE", 101.0, "PERCENT", None, 10080),
    ]
    df = spark.createDataFrame(
        rows,
        "id bigint, rule_type string, comparison_operator string, threshold_value double, threshold_unit string, "
        "event_type string, cooldown_minutes int",
    )
    assert broken(df, quality.rule_checks()) == {
        (3, "rule_type_known"), (3, "rule_shape"), (4, "operator_known"), (5, "rule_shape"), (5, "threshold_unit_known"),
        (6, "rule_shape"), (7, "cooldown_range"), (8, "cooldown_range"), (9, "event_known"),
        (10, "threshold_humidity_range"),
    }


def test_clean_tables_have_no_violations(spark):
    for name, checks in (
        ("readings", quality.reading_checks()), ("rules", quality.rule_checks()),
        ("sensors", quality.sensor_checks()), ("users", quality.user_checks()),
    ):
        assert broken(getattr(driver_tables, name)(spark, SMALL), checks) == set(), name
    rules, sensors = driver_tables.rules(spark, SMALL), driver_tables.sensors(spark, SMALL)
    assert quality.rule_sensor_violations(rules, sensors).count() == 0
    assert quality.rule_owner_mismatch(rules, sensors).count() == 0
    assert quality.orphans(rules, sensors, "sensor_id", "alert_rules").count() == 0


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "A@x"), (2, "a@X"), (3, None), (4, None), (5, "b")], "id bigint, email string")
    got = quality.duplicate_keys({"app_users": df}, {"app_users": {"email": (F.lower("email"),)}}).collect()
    assert [(r.key_value, r.n_rows) for r in got] == [("a@x", 2)]


def test_name_taken(spark):
    sensors = spark.createDataFrame([(1, 7, "Hall"), (2, 7, "Attic"), (3, 8, "hall")], "id bigint, owner_id bigint, name string")
    wanted = spark.createDataFrame(
        [(None, 7, " HALL "), (1, 7, "hall"), (2, 7, "hall"), (None, 8, "attic")], "id bigint, owner_id bigint, name string"
    )
    got = {(r.id, r.owner_id, r.name) for r in quality.name_taken(wanted, sensors).collect()}
    assert got == {(None, 7, " HALL "), (2, 7, "hall")}


def test_canonical_rules(spark):
    sensors = spark.createDataFrame(
        [(1, 1, "TEMPERATURE"), (2, 1, "HUMIDITY"), (3, 1, "MOTION"), (4, 2, "MOTION")], "id bigint, owner_id bigint, type string"
    )
    users = spark.createDataFrame([(1, "FAHRENHEIT")], "id bigint, preferred_temperature_unit string")
    n, e = "NUMERIC_THRESHOLD", "EVENT_DETECTED"
    rows = [
        (1, 1, 1, n, "ABOVE", 212.0, 60), (2, 1, 2, n, "BELOW", 40.0, 60), (3, 1, 3, e, None, None, 60),
        (4, 1, 3, n, "ABOVE", 1.0, 60), (5, 1, 1, e, None, None, 60), (6, 1, 4, e, None, None, 60),
        (7, 1, 2, n, "ABOVE", 101.0, 60), (8, 1, 1, n, "ABOVE", -460.0, 60), (9, 1, 1, n, None, 1.0, 60),
        (10, 1, 1, n, "ABOVE", float("nan"), 60), (11, 1, 1, n, "ABOVE", 1.0, 0), (12, 1, 1, n, "ABOVE", 1.0, None),
        (13, 1, 99, e, None, None, 60),
    ]
    forms = spark.createDataFrame(
        rows,
        "form_id bigint, owner_id bigint, sensor_id bigint, rule_type string, comparison_operator string, "
        "threshold_value double, cooldown_minutes int",
    )
    got = {r.form_id: r for r in quality.canonical_rules(forms, sensors, users).collect()}
    assert (got[1].threshold_value, got[1].threshold_unit, got[2].threshold_unit) == (100.0, "C", "PERCENT")
    assert got[3].event_type == "MOTION_DETECTED" and got[3].threshold_value is None
    assert [got[i].status for i in range(1, 14)] == [
        "OK", "OK", "OK", "WRONG_SENSOR_TYPE", "WRONG_SENSOR_TYPE", "SENSOR_NOT_OWNED", "THRESHOLD_OUT_OF_RANGE",
        "THRESHOLD_OUT_OF_RANGE", "INVALID_FORM", "INVALID_FORM", "INVALID_FORM", "INVALID_FORM", "SENSOR_NOT_OWNED",
    ]


def test_retention_edges(spark):
    now = at("2024-01-30 12:00:00")
    edge = now - dt.timedelta(days=14)
    step = dt.timedelta(microseconds=1)
    df = spark.createDataFrame([(1, edge), (2, edge - step), (3, now)], "id bigint, recorded_at timestamp")
    assert {r.id for r in retention.retained_readings(df, now).collect()} == {1, 3}
    df = spark.createDataFrame([(1, now), (2, now + step), (3, now - step)], "id bigint, expires_at timestamp")
    assert {r.id for r in retention.retained_challenges(df, now).collect()} == {2}


def test_purge_drops_days_and_rewrites_one(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS stored_readings")
    data = driver_tables.readings(spark, SMALL).withColumn("recorded_date", F.to_date("recorded_at"))
    data.write.partitionBy("recorded_date").saveAsTable("stored_readings")
    before = {row[0] for row in spark.sql("SHOW PARTITIONS stored_readings").collect()}
    assert len(before) == 30
    retention.purge_readings(spark, "stored_readings", driver_tables.AS_OF)
    left = spark.table("stored_readings")
    want = retention.retained_readings(data, driver_tables.AS_OF)
    assert left.count() == want.count() == 384
    assert left.select(*want.columns).exceptAll(want).count() == 0
    assert len(spark.sql("SHOW PARTITIONS stored_readings").collect()) == 15
    gone = spark.createDataFrame([(3,), (4,)], "id bigint")
    retention.purge_sensor_readings(spark, "stored_readings", gone)
    assert spark.table("stored_readings").select(*want.columns).exceptAll(want.where("sensor_id NOT IN (3, 4)")).count() == 0
    assert spark.table("stored_readings").count() == want.where("sensor_id NOT IN (3, 4)").count()
    everything = driver_tables.sensors(spark, SMALL).where("id <> 0")
    retention.purge_sensor_readings(spark, "stored_readings", everything)
    assert {r.sensor_id for r in spark.table("stored_readings").select("sensor_id").distinct().collect()} == {0}
    retention.purge_readings(spark, "stored_readings", driver_tables.AS_OF + dt.timedelta(days=60))
    assert spark.table("stored_readings").count() == 0


def test_cascading_delete(spark):
    sensors, readings, rules = (getattr(driver_tables, n)(spark, SMALL) for n in ("sensors", "readings", "rules"))
    left = retention.delete_sensors(sensors, readings, rules, sensors.where("id IN (3, 4)"))
    assert left[0].count() == 13 and left[2].count() == 13
    assert left[1].count() == readings.where("sensor_id NOT IN (3, 4)").count()


def test_lists(spark):
    sensors, rules, users = (getattr(driver_tables, n)(spark, SMALL) for n in ("sensors", "rules", "users"))
    listed = recent.sensor_list(sensors).collect()
    assert [(r.owner_id, -r.id) for r in listed] == sorted((r.owner_id, -r.id) for r in listed)
    assert [r.id for r in recent.owner_sensor_list(sensors, 3).collect()] == [13, 3]
    odd = rules.withColumn("threshold_unit", F.when(F.col("sensor_id") == 0, "PERCENT").otherwise(F.col("threshold_unit")))
    assert recent.rule_list(odd, sensors, users).count() == 14


def test_required_columns_and_primary_keys(spark):
    rows = [(1, None, 5.0, None, "C", None), (2, 3, 5.0, None, "C", None), (2, 3, 6.0, None, "C", None)]
    df = spark.createDataFrame(rows, "id long, sensor_id long, numeric_value double, boolean_value boolean, unit string, recorded_at timestamp")
    checks = {**quality.reading_checks(), **quality.required(READINGS, df)}
    found = [(r.rule, r.row_id) for r in quality.violations(df, "sensor_readings", checks).collect()]
    assert sorted(found) == [
        ("recorded_at_required", 1), ("recorded_at_required", 2), ("recorded_at_required", 2), ("sensor_id_required", 1)
    ]
    twice = quality.duplicate_keys({"sensor_readings": df}).collect()
    assert [(r.table_name, r.rule, r.key_value, r.n_rows) for r in twice] == [("sensor_readings", "primary_key", "2", 2)]
