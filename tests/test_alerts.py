"""Rule matching, cooldown properties, event records and messages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import alerts
from hearthlog.sources import driver_tables, templates
from tests.conftest import SMALL, at

RULE = (
    "id bigint, owner_id bigint, sensor_id bigint, rule_type string, comparison_operator string, "
    "threshold_value double, threshold_unit string, event_type string, enabled boolean, created_at timestamp, "
    "updated_at timestamp, cooldown_minutes int, last_triggered_at timestamp"
)
READING = "id bigint, sensor_id bigint, numeric_value double, boolean_value boolean, unit string, recorded_at timestamp"
OLD, NOW = at("2024-01-01 00:00:00"), at("2024-01-30 12:00:00")


def numeric(rule_id, operator, threshold, unit="C", sensor=1, owner=1, enabled=True, created=OLD):
    return (rule_id, owner, sensor, "NUMERIC_THRESHOLD", operator, threshold, unit, None, enabled, created, created, 60, None)


def event(rule_id, sensor=2, owner=1):
    return (rule_id, owner, sensor, "EVENT_DETECTED", None, None, None, "MOTION_DETECTED", True, OLD, OLD, 60, None)


@pytest.fixture(scope="module")
def users(spark):
    rows = [
        (1, "a@b.c", "ENGLISH", "FAHRENHEIT", "Europe/Istanbul", OLD),
        (2, "d@e.f", "TURKISH", "CELSIUS", "UTC", OLD),
        (3, "g@h.i", "ENGLISH", "CELSIUS", "UTC", None),
    ]
    return spark.createDataFrame(
        rows,
        "id bigint, email string, preferred_language string, preferred_temperature_unit string, "
        "preferred_timezone string, email_verified_at timestamp",
    )


def matched(spark, rules, readings, users):
    got = alerts.alert_matches(
        spark.createDataFrame(readings, READING), spark.createDataFrame(rules, RULE), users
    )
    return {(r.rule_id, r.reading_id) for r in got.collect()}


def test_matching(spark, users):
    rules = [
        numeric(1, "ABOVE", 30.0), numeric(2, "BELOW", 30.0), numeric(3, "ABOVE", 30.0, unit="PERCENT"),
        numeric(4, "ABOVE", 30.0, enabled=False), numeric(5, "ABOVE", 30.0, owner=3), event(6),
        numeric(7, "ABOVE", 30.0, created=at("2024-01-31 00:00:00")),
    ]
    readings = [
        (1, 1, 30.0, None, "C", NOW),  # equal to the threshold: nothing
        (2, 1, 30.1, None, "C", NOW),
        (3, 1, 29.9, None, "C", NOW),
        (4, 2, None, True, None, NOW),
        (5, 2, None, False, None, NOW),
        (6, 1, float("nan"), None, "C", NOW),
        (7, 2, None, True, "C", NOW),  # a unit on a motion reading
        (8, 1, 50.0, True, "C", NOW),  # both values present
        (9, 9, 50.0, None, "C", NOW),  # another sensor
    ]
    assert matched(spark, rules, readings, users) == {(1, 2), (2, 3), (6, 4)}


def test_cooldown_active(spark):
    rows = [(OLD, 60, at("2024-01-01 00:59:59.999999"), True), (OLD, 60, at("2024-01-01 01:00:00"), False), (None, 60, OLD, False)]
    df = spark.createDataFrame(rows, "last timestamp, c int, t timestamp, want boolean")
    got = df.select(alerts.cooldown_active(F.col("last"), F.col("c"), F.col("t")), "want").collect()
    assert all(have == want for have, want in got)


def test_fixture_counts_and_properties(spark):
    data = driver_tables.readings(spark, SMALL), driver_tables.rules(spark, SMALL), driver_tables.users(spark, SMALL)
    rows = alerts.evaluate_alerts(*data).orderBy("rule_id", "recorded_at", "reading_id").collect()
    assert len(rows) == 245 and sum(r.fired for r in rows) == 72
    last = {}
    for r in rows:
        wait = dt.timedelta(minutes=r.cooldown_minutes)
        if r.fired:
            assert r.rule_id not in last or r.recorded_at - last[r.rule_id] >= wait
            last[r.rule_id] = r.recorded_at
        else:
            assert r.recorded_at - last[r.rule_id] < wait
    counts = alerts.suppressed_counts(alerts.evaluate_alerts(*data)).agg(F.sum("n_suppressed")).first()[0]
    assert counts == 245 - 72


def test_hot_rules_give_the_same_alerts(spark):
    matches = alerts.alert_matches(*(getattr(driver_tables, n)(spark, SMALL) for n in ("readings", "rules", "users")))
    plain = alerts.cooldown(matches)
    split = alerts.cooldown(matches, hot_key_events=15, stripe_events=10)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_messages(spark, users):
    sensors = spark.createDataFrame(
        [(1, "TEMPERATURE", "Boiler {0}", "Cellar", "Izmir", "Konak"), (2, "MOTION", "Door", "Hall", "Ankara", "Cankaya"),
         (3, "HUMIDITY", "Bath", "Upstairs", "Bursa", "Nilufer")],
        "id bigint, type string, name string, home_location string, city string, district string",
    )
    rules = spark.createDataFrame(
        [numeric(1, "ABOVE", 30.0), event(2, owner=2), numeric(3, "BELOW", 1234.5, "PERCENT", sensor=3, owner=2)], RULE
    ).withColumn("cooldown_minutes", F.lit(10080))
    fires = spark.createDataFrame(
        [(1, 10, 1, NOW, 31.0), (2, 20, 2, NOW, None), (3, 30, 3, NOW, 0.126)],
        "rule_id bigint, reading_id bigint, sensor_id bigint, recorded_at timestamp, numeric_value double",
    )
    events = alerts.alert_events(fires, rules, sensors, users)
    record = {r.rule_id: r for r in events.collect()}
    assert record[1].recipient.timezone == "Europe/Istanbul" and record[1].sensor.name == "Boiler {0}"
    assert record[1].trigger.threshold_value == 30.0 and record[2].trigger is None
    got = {r.rule_id: r for r in alerts.alert_messages(events, templates.default_templates(spark)).collect()}
    assert got[1].subject == "Temperature alert: Boiler {0}"
    assert got[1].body == (
        "An alert rule has been triggered.\n\nSensor: Boiler {0}\nHome location: Cellar\nLocation: Izmir, Konak\n"
        "Condition: Above threshold\nMeasured temperature: 87.8 °F\nThreshold: 86.0 °F\n"
        "Recorded at: 30-01-2024 15:00:00 +03:00\nCooldown: 10,080 minutes\n\n"
        "This email was sent because alerts are enabled for this sensor."
    )
    assert got[2].email == "d@e.f" and "Olay: Hareket algılandı\nKayıt zamanı: 30-01-2024 12:00:00 Z\n" in got[2].body
    assert "Ölçülen bağıl nem: 0,13 % RH\nEşik değeri: 1.234,5 % RH\n" in got[3].body
    assert "Bekleme süresi: 10.080 dakika" in got[3].body


def test_bundle_file(spark, tmp_path):
    path = tmp_path / "texts.properties"
    path.write_text("# comment\n\na.b=One\\nTwo = 2\n  c = x{0}\n", encoding="utf-8")
    rows = templates.read_bundle(spark, str(path), "ENGLISH").collect()
    assert {(r.lang, r.key, r.template) for r in rows} == {("ENGLISH", "a.b", "One\nTwo = 2"), ("ENGLISH", "c", "x{0}")}


def test_two_half_runs_fire_what_one_run_fires(spark):
    readings, rules, users = (getattr(driver_tables, n)(spark, SMALL) for n in ("readings", "rules", "users"))
    once = alerts.fired(alerts.evaluate_alerts(readings, rules, users))
    middle = F.lit("2024-01-16").cast("timestamp")
    first = alerts.fired(alerts.evaluate_alerts(readings.where(F.col("recorded_at") < middle), rules, users))
    kept = alerts.last_triggered(rules, first)
    second = alerts.fired(alerts.evaluate_alerts(readings.where(F.col("recorded_at") >= middle), kept, users))
    ids = lambda df: sorted((r.rule_id, r.reading_id) for r in df.collect())
    assert ids(first.unionByName(second)) == ids(once) and kept.columns == rules.columns
