"""Table schemas and the closed value sets of the sensor data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed sets stored as strings.
SENSOR_TYPES = ("TEMPERATURE", "HUMIDITY", "MOTION")
NUMERIC_SENSOR_TYPES = ("TEMPERATURE", "HUMIDITY")
MEASUREMENT_UNITS = ("C", "PERCENT")
RULE_TYPES = ("NUMERIC_THRESHOLD", "EVENT_DETECTED")
COMPARISON_OPERATORS = ("ABOVE", "BELOW")
EVENT_TYPES = ("MOTION_DETECTED",)
LANGUAGES = ("ENGLISH", "TURKISH")
TEMPERATURE_UNITS = ("CELSIUS", "FAHRENHEIT", "KELVIN")

# Numeric limits.
ABSOLUTE_ZERO_C = -273.15
HUMIDITY_MIN = 0.0
HUMIDITY_MAX = 100.0
COOLDOWN_MIN_MINUTES = 1
COOLDOWN_MAX_MINUTES = 10080
TOKEN_MAX_CHARS = 256
RETENTION_DAYS = 14
RECENT_ROWS = 10

# Outcomes of one reading request, in the order the checks run.
NOT_FOUND = "NOT_FOUND_404"
INVALID_REQUEST = "INVALID_REQUEST_400"
INVALID_TOKEN = "INVALID_TOKEN_401"
INACTIVE = "INACTIVE_409"
TYPE_MISMATCH = "TYPE_MISMATCH_400"
ACCEPTED = "ACCEPTED"

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType(), False),
        T.StructField("received_at", T.TimestampType(), False),
        T.StructField("path", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

READINGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("sensor_id", T.LongType(), False),
        T.StructField("numeric_value", T.DoubleType()),
        T.StructField("boolean_value", T.BooleanType()),
        T.StructField("unit", T.StringType()),
        T.StructField("recorded_at", T.TimestampType(), False),
    ]
)

SENSORS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("owner_id", T.LongType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("city", T.StringType(), False),
        T.StructField("district", T.StringType(), False),
        T.StructField("home_location", T.StringType(), False),
        T.StructField("time_zone_id", T.StringType(), False),
        T.StructField("active", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
        T.StructField("ingestion_token_hash", T.StringType()),
        T.StructField("last_seen_at", T.TimestampType()),
    ]
)

USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("email", T.StringType(), False),
        T.StructField("preferred_language", T.StringType(), False),
        T.StructField("preferred_temperature_unit", T.StringType(), False),
        T.StructField("preferred_timezone", T.StringType(), False),
        T.StructField("enabled", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
        T.StructField("email_verified_at", T.TimestampType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("owner_id", T.LongType(), False),
        T.StructField("sensor_id", T.LongType(), False),
        T.StructField("rule_type", T.StringType(), False),
        T.StructField("comparison_operator", T.StringType()),
        T.StructField("threshold_value", T.DoubleType()),
        T.StructField("threshold_unit", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("enabled", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
        T.StructField("cooldown_minutes", T.IntegerType(), False),
        T.StructField("last_triggered_at", T.TimestampType()),
    ]
)

CHALLENGES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("code_hash", T.StringType(), False),
        T.StructField("issued_at", T.TimestampType(), False),
        T.StructField("expires_at", T.TimestampType(), False),
        T.StructField("resend_available_at", T.TimestampType(), False),
        T.StructField("failed_attempts", T.IntegerType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

TEMPLATES = T.StructType(
    [
        T.StructField("lang", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("template", T.StringType(), False),
    ]
)
