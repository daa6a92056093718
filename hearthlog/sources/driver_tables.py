"""Sensor tables derived from the benchmark star-schema tables.

Only queries and tests use this module: the benchmark data has no sensor tables, so users come
from ``customer``, sensors and requests from ``events``, drafts with deliberate defects from
``part``, ``orders`` and ``customer``. Every derivation is a plain projection of its table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from hearthlog.session import cut

AS_OF = dt.datetime(2024, 1, 30, 12, 0, 0, tzinfo=dt.timezone.utc)

# Zones handed out in turn.
ZONES = (
    "UTC",
    "Europe/Istanbul",
    "America/New_York",
    "Asia/Kathmandu",
    "America/Sao_Paulo",
    "Australia/Lord_Howe",
)
_ZONE_ARRAY = "array(" + ", ".join(f"'{zone}'" for zone in ZONES) + ")"


def zone(index_sql: str) -> str:
    return f"element_at({_ZONE_ARRAY}, cast(({index_sql}) % {len(ZONES)} + 1 as int))"


# The times are declared as instants: without the declaration they load as zone-less values, and a
# cast on every row would keep time bounds from reaching the scan.
_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written as a pattern, so that both a single file and a folder of files can be streamed.
    return spark.readStream.schema(_EVENTS).parquet(f"{sf_dir}/events.parque[t]")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "lower(c_name) || '@example.com' AS email",
        "CASE WHEN c_custkey % 2 = 0 THEN 'ENGLISH' ELSE 'TURKISH' END AS preferred_language",
        "CASE c_custkey % 3 WHEN 0 THEN 'CELSIUS' WHEN 1 THEN 'FAHRENHEIT' ELSE 'KELVIN' END "
        "AS preferred_temperature_unit",
        f"{zone('c_custkey')} AS preferred_timezone",
        "true AS enabled",
        "timestamp'2023-12-01 00:00:00' AS created_at",
        "timestamp'2023-12-01 00:00:00' AS updated_at",
        "CASE WHEN c_custkey % 5 <> 4 THEN timestamp'2023-12-02 00:00:00' END AS email_verified_at",
    )


def sensor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct sensors of the feed, written down as the small table they are.

    A stored sensor table has a known size and is read as often as a query likes; a DISTINCT over
    the whole feed would be repeated for every use.
    """
    return cut(events(spark, sf_dir).selectExpr("user_id AS u").distinct())


_SENSOR_TYPE = "CASE u % 3 WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'HUMIDITY' ELSE 'MOTION' END"


def sensors(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The sensor table; pass ``ids`` to derive several tables from one list of sensors."""
    return (ids or sensor_ids(spark, sf_dir)).selectExpr(
        "u AS id",
        "u % 10 AS owner_id",
        f"{_SENSOR_TYPE} AS type",
        "'sensor-' || u AS name",
        "'Izmir' AS city",
        "'Konak' AS district",
        "'Living room' AS home_location",
        f"{zone('u div 3')} AS time_zone_id",
        "u % 7 <> 6 AS active",
        "timestamp'2023-12-10 00:00:00' AS created_at",
        "timestamp'2023-12-10 00:00:00' AS updated_at",
        "sha2('tok-' || u, 256) AS ingestion_token_hash",
        "cast(NULL AS timestamp) AS last_seen_at",
    )


def rules(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """One alert rule per sensor."""
    return (ids or sensor_ids(spark, sf_dir)).selectExpr(
        "2 * u AS id",
        "u % 10 AS owner_id",
        "u AS sensor_id",
        "CASE WHEN u % 3 = 2 THEN 'EVENT_DETECTED' ELSE 'NUMERIC_THRESHOLD' END AS rule_type",
        "CASE WHEN u % 3 <> 2 THEN CASE WHEN u % 2 = 0 THEN 'ABOVE' ELSE 'BELOW' END END AS comparison_operator",
        "CASE u % 3 WHEN 0 THEN 30D WHEN 1 THEN 40D END AS threshold_value",
        "CASE u % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'PERCENT' END AS threshold_unit",
        "CASE WHEN u % 3 = 2 THEN 'MOTION_DETECTED' END AS event_type",
        "u % 11 <> 0 AS enabled",
        "timestamp'2023-12-15 00:00:00' AS created_at",
        "timestamp'2023-12-15 00:00:00' AS updated_at",
        "CASE WHEN u % 4 < 2 THEN 1440 ELSE 10080 END AS cooldown_minutes",
        "cast(NULL AS timestamp) AS last_triggered_at",
    )


def as_requests(source: DataFrame) -> DataFrame:
    """Reading requests, one per event; works on a batch and on a stream."""
    kinds = source.selectExpr(
        "event_id",
        "ts AS received_at",
        "user_id AS u",
        "event_type",
        "value",
        "(user_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) % 3 AS k",
    )
    return kinds.selectExpr(
        "event_id AS request_id",
        "received_at",
        "CASE k WHEN 0 THEN CASE WHEN event_id % 10 = 0 THEN '/readings' ELSE '/readings/temperature' END "
        "WHEN 1 THEN '/readings/humidity' ELSE '/readings/motion' END AS path",
        "'sensorToken=' || CASE WHEN event_id % 89 = 0 THEN 'bad-' ELSE 'tok-' END || u || "
        "CASE k WHEN 0 THEN '&celsiusValue=' || (value - CASE WHEN event_id % 50 = 0 THEN 300D ELSE 20D END) "
        "WHEN 1 THEN '&humidityPercentage=' || value "
        "ELSE '&motionDetected=' || (event_type IN ('click', 'error')) END AS body",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(events(spark, sf_dir))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings the ingestion job accepts, derived without the text round trip.

    Jobs over stored readings start here, so that their plan holds their own work only; a test
    checks that the ingestion job gives the same rows.
    """
    return as_readings(events(spark, sf_dir))


def as_readings(source: DataFrame) -> DataFrame:
    """Accepted readings of a batch or a stream of events."""
    return (
        source.where("event_id % 97 <> 0 AND event_id % 89 <> 0 AND user_id % 7 <> 6")
        .where(
            "CASE user_id % 3 WHEN 0 THEN value - CASE WHEN event_id % 50 = 0 THEN 300D ELSE 20D END >= -273.15D "
            "WHEN 1 THEN value BETWEEN 0D AND 100D ELSE true END"
        )
        .selectExpr(
            "event_id AS id",
            "user_id AS sensor_id",
            "CASE user_id % 3 WHEN 0 THEN value - CASE WHEN event_id % 50 = 0 THEN 300D ELSE 20D END "
            "WHEN 1 THEN value END AS numeric_value",
            "CASE WHEN user_id % 3 = 2 THEN event_type IN ('click', 'error') END AS boolean_value",
            "CASE user_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'PERCENT' END AS unit",
            "ts AS recorded_at",
        )
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked readings: every event, some with a broken shape, unit or value."""
    return events(spark, sf_dir).selectExpr(
        "event_id AS id",
        "user_id AS sensor_id",
        "CASE WHEN event_id % 43 = 0 THEN double('NaN') WHEN event_id % 47 = 0 THEN double('Infinity') "
        "WHEN user_id % 3 = 0 THEN value - CASE WHEN event_id % 50 = 0 THEN 300D ELSE 20D END "
        "WHEN user_id % 3 = 1 THEN value END AS numeric_value",
        "CASE WHEN user_id % 3 = 2 OR event_id % 41 = 0 THEN event_type IN ('click', 'error') END AS boolean_value",
        "CASE WHEN event_id % 37 = 0 THEN 'F' WHEN event_id % 31 = 0 THEN NULL "
        "WHEN user_id % 3 = 0 THEN 'C' WHEN user_id % 3 = 1 THEN 'PERCENT' END AS unit",
        "ts AS recorded_at",
    )


def raw_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked rule rows, one per order, many of them broken in some column."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "o_orderkey % 12 AS owner_id",
        "o_custkey AS sensor_id",
        "CASE WHEN o_orderkey % 23 = 0 THEN 'UNKNOWN' WHEN o_orderstatus = 'P' THEN 'EVENT_DETECTED' "
        "ELSE 'NUMERIC_THRESHOLD' END AS rule_type",
        "CASE WHEN o_orderkey % 19 = 0 THEN 'EQUAL' WHEN o_orderstatus = 'P' AND o_orderkey % 5 <> 0 THEN NULL "
        "WHEN o_orderkey % 2 = 0 THEN 'ABOVE' ELSE 'BELOW' END AS comparison_operator",
        "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 29 = 0 THEN double('NaN') "
        "ELSE o_totalprice / 500D - 300D END AS threshold_value",
        "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 17 = 0 THEN 'K' "
        "WHEN o_custkey % 3 = 0 THEN 'C' ELSE 'PERCENT' END AS threshold_unit",
        "CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 13 = 0 THEN 'DOOR_OPENED' "
        "ELSE 'MOTION_DETECTED' END END AS event_type",
        "true AS enabled",
        "cast(o_orderdate AS timestamp) AS created_at",
        "cast(o_orderdate AS timestamp) AS updated_at",
        "cast(o_orderkey % 10500 AS int) AS cooldown_minutes",
        "cast(NULL AS timestamp) AS last_triggered_at",
    )


def rule_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted rule definitions, thresholds in the owner's own unit."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS form_id",
        "CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 11 ELSE o_custkey % 10 END AS owner_id",
        "o_custkey AS sensor_id",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'EVENT_DETECTED' ELSE 'NUMERIC_THRESHOLD' END AS rule_type",
        "CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 21 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'ABOVE' "
        "ELSE 'BELOW' END AS comparison_operator",
        "CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 25 = 0 THEN NULL ELSE o_totalprice / 1000D - 200D END "
        "AS threshold_value",
        "CASE WHEN o_orderkey % 27 = 0 THEN NULL ELSE cast(o_orderkey % 10500 AS int) END AS cooldown_minutes",
    )


def raw_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked sensor rows, one per part: blank and long texts, repeated names and tokens."""
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "p_partkey % 160 AS owner_id",
        "CASE WHEN p_partkey % 31 = 0 THEN 'PRESSURE' "
        "ELSE CASE p_partkey % 3 WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'HUMIDITY' ELSE 'MOTION' END END AS type",
        "CASE WHEN p_partkey % 29 = 0 THEN '  ' WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name",
        "CASE WHEN p_partkey % 37 = 0 THEN repeat('x', 101) ELSE 'Izmir' END AS city",
        "CASE WHEN p_partkey % 41 = 0 THEN '' ELSE 'Konak' END AS district",
        "CASE WHEN p_partkey % 43 = 0 THEN ' ' ELSE 'Kitchen' END AS home_location",
        "CASE WHEN p_partkey % 47 = 0 THEN 'Mars/Olympus' WHEN p_partkey % 53 = 0 THEN '' "
        f"ELSE {zone('p_partkey')} END AS time_zone_id",
        "true AS active",
        "timestamp'2023-12-10 00:00:00' AS created_at",
        "timestamp'2023-12-10 00:00:00' AS updated_at",
        "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE sha2('part-' || (p_partkey - p_partkey % 50 % 2), 256) END "
        "AS ingestion_token_hash",
        "cast(NULL AS timestamp) AS last_seen_at",
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked user rows, one per customer."""
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_custkey % 53 = 0 THEN '   ' "
        "WHEN c_custkey % 14 = 0 THEN upper(c_mktsegment) || c_nationkey || '@EXAMPLE.COM' "
        "ELSE lower(c_name) || '@example.com' END AS email",
        "CASE WHEN c_custkey % 59 = 0 THEN 'GERMAN' WHEN c_custkey % 2 = 0 THEN 'ENGLISH' ELSE 'TURKISH' END "
        "AS preferred_language",
        "CASE WHEN c_custkey % 61 = 0 THEN 'RANKINE' ELSE 'CELSIUS' END AS preferred_temperature_unit",
        f"CASE WHEN c_custkey % 73 = 0 THEN '' ELSE {zone('c_custkey')} END AS preferred_timezone",
        "true AS enabled",
        "timestamp'2023-12-01 00:00:00' AS created_at",
        "timestamp'2023-12-01 00:00:00' AS updated_at",
        "CASE WHEN c_custkey % 67 = 0 THEN timestamp'2023-11-30 00:00:00' "
        "WHEN c_custkey % 5 <> 4 THEN timestamp'2023-12-02 00:00:00' END AS email_verified_at",
    )


def challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Email verification challenges, one per customer, expiring around the reference instant."""
    return _challenges(_table(spark, sf_dir, "customer").selectExpr("c_custkey AS n"))


def reset_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Password reset challenges, one per part."""
    return _challenges(_table(spark, sf_dir, "part").selectExpr("p_partkey AS n"))


def _challenges(numbers: DataFrame) -> DataFrame:
    base = "timestamp'2024-01-30 11:00:00' + make_dt_interval(0, 0, cast(n % 90 AS int))"
    later = lambda minutes: f"{base} + make_dt_interval(0, 0, {minutes})"
    return numbers.selectExpr(
        "n AS id",
        "CASE WHEN n % 40 = 1 THEN n - 1 ELSE n END AS user_id",
        "CASE WHEN n % 34 = 0 THEN ' ' ELSE sha2('code-' || n, 256) END AS code_hash",
        f"{base} AS issued_at",
        later("CASE WHEN n % 38 = 0 THEN 0 ELSE 15 END") + " AS expires_at",
        later("CASE WHEN n % 46 = 0 THEN 21 ELSE 1 END") + " AS resend_available_at",
        "cast(n % 7 - CASE WHEN n % 58 = 0 THEN 7 ELSE 0 END AS int) AS failed_attempts",
        later("CASE WHEN n % 62 = 0 THEN 5 ELSE 0 END") + " AS created_at",
        later("CASE WHEN n % 74 = 0 THEN -5 ELSE 0 END") + " AS updated_at",
    )


def code_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for a one-time code, one per event: an address and a client key (some blank)."""
    return events(spark, sf_dir).selectExpr(
        "event_id AS id",
        "ts AS requested_at",
        "'user-' || user_id AS address_key",
        "CASE WHEN user_id % 10 = 3 THEN '  ' ELSE ' client-' || (user_id % 10) END AS client_key",
    )


def adc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw 10-bit thermistor samples, one per line item."""
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS line_id",
        "cast(l_extendedprice AS bigint) % 1024 AS adc",
    )


def text_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-written values, one per event: motion words and numbers with a comma or a point."""
    return events(spark, sf_dir).selectExpr(
        "event_id AS id",
        "CASE event_id % 9 WHEN 0 THEN ' Detected ' WHEN 1 THEN 'YES' WHEN 2 THEN 't' WHEN 3 THEN '1' "
        "WHEN 4 THEN 'clear' WHEN 5 THEN 'No' WHEN 6 THEN '0' WHEN 7 THEN event_type ELSE '' END AS motion_text",
        "CASE event_id % 5 WHEN 0 THEN replace(cast(value AS string), '.', ',') WHEN 1 THEN 'NaN' "
        "WHEN 2 THEN event_type ELSE '  ' || value || ' ' END AS number_text",
    )
