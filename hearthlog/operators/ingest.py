"""Reading requests to readings: decode, classify, split.

The checks run in a fixed order and the first one that fails names the outcome: unknown path,
malformed or out-of-range content, unknown token, inactive sensor, wrong sensor type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog import schema
from hearthlog.functions import numbers, text

# Request path to the sensor type it reports for.
PATHS = {
    "/readings": "TEMPERATURE",
    "/readings/temperature": "TEMPERATURE",
    "/readings/humidity": "HUMIDITY",
    "/readings/motion": "MOTION",
}


# Form field that carries the value of each sensor type.
VALUE_FIELDS = {
    "TEMPERATURE": "celsiusValue",
    "HUMIDITY": "humidityPercentage",
    "MOTION": "motionDetected",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*[F.lit(item) for pair in table.items() for item in pair])
    return F.try_element_at(entries, key)


def decode(requests: DataFrame) -> DataFrame:
    """Token and typed value of each request; NULL where a field is absent or unreadable.

    The steps are separate projections, so that each text is cut out and decoded once.
    """
    body, kind = F.col("body"), F.col("reported_type")
    texts = requests.withColumn("reported_type", _lookup(PATHS, F.col("path"))).select(
        "request_id",
        "received_at",
        "reported_type",
        text.form_field(body, F.lit("sensorToken")).alias("token"),
        text.form_field(body, _lookup(VALUE_FIELDS, kind)).alias("value_text"),
    )
    return texts.select(
        "request_id",
        "received_at",
        "reported_type",
        "token",
        F.when(kind != "MOTION", text.form_double(F.col("value_text"))).alias("numeric_value"),
        F.when(kind == "MOTION", text.form_boolean(F.col("value_text"))).alias("boolean_value"),
    )


def well_formed() -> Column:
    """Structure check over decoded columns: usable token and a value of the reported type."""
    token_ok = (F.length(text.trim_controls(F.col("token"))) > 0) & (
        F.length("token") <= schema.TOKEN_MAX_CHARS
    )
    value_ok = F.when(F.col("reported_type") == "MOTION", F.col("boolean_value").isNotNull()).otherwise(
        numbers.valid_measurement(F.col("reported_type"), F.col("numeric_value"))
    )
    return F.coalesce(token_ok & value_ok, F.lit(False))


def classify(requests: DataFrame, sensors: DataFrame) -> DataFrame:
    """Each request with its outcome and, once its token is known, its sensor.

    Only a narrow row reaches the join: the body and the token are dropped before it. The join is
    left outer on the token hash; rows that cannot match carry their own request id as key, so
    malformed requests spread over the tasks instead of meeting in the NULL group.
    """
    checked = decode(requests).withColumn("well_formed", well_formed())
    keyed = checked.select(
        "request_id",
        "received_at",
        "reported_type",
        "numeric_value",
        "boolean_value",
        "well_formed",
        F.when(F.col("well_formed"), text.token_hash(F.col("token")))
        .otherwise(F.col("request_id").cast("string"))
        .alias("token_hash"),
    )
    registry = sensors.where(F.col("ingestion_token_hash").isNotNull()).select(
        F.col("ingestion_token_hash").alias("token_hash"),
        F.col("id").alias("sensor_id"),
        F.col("type").alias("sensor_type"),
        F.col("active"),
    )
    outcome = (
        F.when(F.col("reported_type").isNull(), schema.NOT_FOUND)
        .when(~F.col("well_formed"), schema.INVALID_REQUEST)
        .when(F.col("sensor_id").isNull(), schema.INVALID_TOKEN)
        .when(~F.col("active"), schema.INACTIVE)
        .when(F.col("reported_type") != F.col("sensor_type"), schema.TYPE_MISMATCH)
        .otherwise(schema.ACCEPTED)
    )
    return keyed.join(registry, "token_hash", "left").select(
        "request_id",
        "received_at",
        "reported_type",
        "sensor_id",
        "numeric_value",
        "boolean_value",
        outcome.alias("outcome"),
    )


def accepted_readings(classified: DataFrame) -> DataFrame:
    """Accepted requests as readings in the canonical unit of their type."""
    return classified.where(F.col("outcome") == schema.ACCEPTED).select(
        F.col("request_id").alias("id"),
        "sensor_id",
        "numeric_value",
        "boolean_value",
        numbers.canonical_unit(F.col("reported_type")).alias("unit"),
        F.col("received_at").alias("recorded_at"),
    )


def rejects(classified: DataFrame) -> DataFrame:
    """Everything that was not accepted, with the reason."""
    return classified.where(F.col("outcome") != schema.ACCEPTED).select(
        "request_id", "received_at", "reported_type", "sensor_id", "outcome"
    )


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))


def last_seen(sensors: DataFrame, readings: DataFrame) -> DataFrame:
    """Sensors with ``last_seen_at`` moved forward to their newest accepted reading."""
    newest = readings.groupBy(F.col("sensor_id").alias("id")).agg(F.max("recorded_at").alias("newest"))
    return (
        sensors.join(newest, "id", "left")
        .withColumn("last_seen_at", F.greatest("last_seen_at", "newest"))
        .drop("newest")
    )
