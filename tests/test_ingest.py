"""Classification of literal requests and of the derived feed."""

from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import ingest
from hearthlog.sources import driver_tables, sinks, tables
from hearthlog.sources.requests import read_requests
from tests.conftest import SMALL, at

NOW = at("2024-01-30 12:00:00")


@pytest.fixture(scope="module")
def registry(spark):
    rows = [(1, "TEMPERATURE", True, "t"), (2, "HUMIDITY", True, "h"), (3, "MOTION", True, "m"), (4, "MOTION", False, "off")]
    df = spark.createDataFrame(rows, "id bigint, type string, active boolean, token string")
    none = spark.createDataFrame([(5, "MOTION", True, None)], df.schema)
    return df.unionByName(none).withColumn("ingestion_token_hash", F.sha2("token", 256)).withColumn(
        "last_seen_at", F.lit(None).cast("timestamp")
    )


CASES = [
    ("/readings", "sensorToken=t&celsiusValue=21.5", "ACCEPTED"),
    ("/readings/temperature", "sensorToken=t&celsiusValue=-273.15", "ACCEPTED"),
    ("/readings/temperature", "sensorToken=t&celsiusValue=-273.16", "INVALID_REQUEST_400"),
    ("/readings/temperature", "sensorToken=t&celsiusValue=NaN", "INVALID_REQUEST_400"),
    ("/readings/temperature", "sensorToken=t&celsiusValue=Infinity", "INVALID_REQUEST_400"),
    ("/readings/temperature", "sensorToken=t&celsiusValue=warm", "INVALID_REQUEST_400"),
    ("/readings/temperature", "sensorToken=t&celsiusValue=", "INVALID_REQUEST_400"),
    ("/readings/temperature", "sensorToken=t", "INVALID_REQUEST_400"),
    ("/readings/temperature", "sensorToken=t&humidityPercentage=5", "INVALID_REQUEST_400"),
    ("/readings/humidity", "sensorToken=h&humidityPercentage=0", "ACCEPTED"),
    ("/readings/humidity", "sensorToken=h&humidityPercentage=100.0", "ACCEPTED"),
    ("/readings/humidity", "sensorToken=h&humidityPercentage=100.01", "INVALID_REQUEST_400"),
    # Range is checked before the token.
    ("/readings/humidity", "sensorToken=nobody&humidityPercentage=-1", "INVALID_REQUEST_400"),
    ("/readings/motion", "sensorToken=m&motionDetected=true", "ACCEPTED"),
    ("/readings/motion", "sensorToken=m&motionDetected=OFF", "ACCEPTED"),
    ("/readings/motion", "sensorToken=m&motionDetected=maybe", "INVALID_REQUEST_400"),
    ("/readings/motion", "sensorToken=nobody&motionDetected=true", "INVALID_TOKEN_401"),
    ("/readings/motion", "sensorToken=off&motionDetected=true", "INACTIVE_409"),
    # Inactive is checked before the type.
    ("/readings/humidity", "sensorToken=off&humidityPercentage=1", "INACTIVE_409"),
    ("/readings/motion", "sensorToken=t&motionDetected=true", "TYPE_MISMATCH_400"),
    ("/readings/motion", "sensorToken=%20%09m%0A&motionDetected=true", "ACCEPTED"),
    ("/readings/motion", "sensorToken=+m+&motionDetected=true", "ACCEPTED"),
    ("/readings/motion", "sensorToken=%20%20&motionDetected=true", "INVALID_REQUEST_400"),
    ("/readings/motion", "sensorToken=&motionDetected=true", "INVALID_REQUEST_400"),
    ("/readings/motion", "sensorToken=%zz&motionDetected=true", "INVALID_REQUEST_400"),
    ("/readings/motion", "sensorToken=" + "x" * 256 + "&motionDetected=true", "INVALID_TOKEN_401"),
    ("/readings/motion", "sensorToken=" + "x" * 257 + "&motionDetected=true", "INVALID_REQUEST_400"),
    ("/readings/motion", "sensorToken=m&sensorToken=nobody&motionDetected=true", "ACCEPTED"),
    ("/readings/motion", None, "INVALID_REQUEST_400"),
    ("/elsewhere", "sensorToken=m&motionDetected=true", "NOT_FOUND_404"),
    (None, "sensorToken=m&motionDetected=true", "NOT_FOUND_404"),
    ("/readings/motion", "sensorToken=" + quote("ü") + "&motionDetected=true", "INVALID_TOKEN_401"),
]


def classified(spark, registry):
    rows = [(i, NOW, path, body) for i, (path, body, _) in enumerate(CASES)]
    requests = spark.createDataFrame(rows, "request_id bigint, received_at timestamp, path string, body string")
    return ingest.classify(requests, registry)


def test_outcomes(spark, registry):
    got = {row.request_id: row.outcome for row in classified(spark, registry).collect()}
    assert [(body, got[i]) for i, (_, body, _) in enumerate(CASES)] == [(body, want) for _, body, want in CASES]


def test_split_is_complete(spark, registry):
    rows = classified(spark, registry)
    accepted, rejected = ingest.accepted_readings(rows), ingest.rejects(rows)
    assert accepted.count() + rejected.count() == len(CASES)
    shapes = {(r.unit, r.numeric_value is None, r.boolean_value is None) for r in accepted.collect()}
    assert shapes == {("C", False, True), ("PERCENT", False, True), (None, True, False)}


def test_last_seen_moves_forward_only(spark, registry):
    readings = spark.createDataFrame([(1, NOW), (2, NOW)], "sensor_id bigint, recorded_at timestamp")
    later = at("2024-02-01 00:00:00")
    known = registry.withColumn("last_seen_at", F.when(F.col("id") == 2, F.lit(later)))
    seen = ingest.last_seen(known, readings).select("id", F.date_format("last_seen_at", "MM-dd").alias("d"))
    assert {row.id: row.d for row in seen.collect()} == {1: "01-30", 2: "02-01", 3: None, 4: None, 5: None}


def test_short_cut_equals_the_job(spark):
    rows = ingest.classify(driver_tables.requests(spark, SMALL), driver_tables.sensors(spark, SMALL))
    job, short = ingest.accepted_readings(rows), driver_tables.readings(spark, SMALL)
    assert job.count() == 832
    assert job.exceptAll(short.select(*job.columns)).count() == 0
    assert short.select(*job.columns).exceptAll(job).count() == 0


def test_tables_round_trip(spark, tmp_path):
    source = driver_tables.requests(spark, SMALL)
    for kind in ("parquet", "json"):
        path = str(tmp_path / kind)
        source.write.format(kind).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").save(path)
        assert read_requests(spark, path, kind).exceptAll(source).count() == 0
    rows = ingest.classify(source, driver_tables.sensors(spark, SMALL))
    accepted = ingest.accepted_readings(rows)
    sinks.write_readings(accepted, str(tmp_path / "readings"))
    sinks.write_rejects(ingest.rejects(rows), str(tmp_path / "rejects"))
    stored = tables.read_readings(spark, str(tmp_path / "readings"))
    assert stored.drop("recorded_date").exceptAll(accepted).count() == 0
    assert stored.where(F.col("recorded_date") != F.to_date("recorded_at")).count() == 0
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 168
    bounded = tables.in_range(stored, at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"))
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(recorded_at), GreaterThanOrEqual(recorded_at" in plan
    assert "PartitionFilters: [isnotnull(recorded_date" in plan
    by_hand = accepted.where("recorded_at >= '2024-01-10' AND recorded_at < '2024-01-12'")
    assert bounded.count() == by_hand.count() > 0
    assert tables.for_owner(driver_tables.sensors(spark, SMALL), 3).count() == 2
    assert tables.for_owner(driver_tables.sensors(spark, SMALL), 3, 13).count() == 1
    kinds = driver_tables.sensors(spark, SMALL)
    assert tables.numeric_sensors(kinds).count() + tables.motion_sensors(kinds).count() == 15


@pytest.mark.parametrize("name", ["sensors", "users", "rules", "challenges"])
def test_stored_dimensions(spark, tmp_path, name):
    source = getattr(driver_tables, name)(spark, SMALL)
    source.write.parquet(str(tmp_path / name))
    stored = getattr(tables, f"read_{name}")(spark, str(tmp_path / name))
    assert stored.columns == source.columns
    assert stored.count() > 0 and stored.exceptAll(source).count() == 0
