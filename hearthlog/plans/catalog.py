"""Every named query: a job of this library over tables derived from the benchmark data."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog import schema
from hearthlog.functions import numbers, text, units, zones
from hearthlog.operators import (
    alerts,
    feeds,
    ingest,
    key_filter,
    labels,
    quality,
    recent,
    retention,
    stats,
    throttle,
)
from hearthlog.session import configure, scratch_dir
from hearthlog.sources import driver_tables as tables
from hearthlog.sources import alert_sink, bucketed, request_log, sinks
from hearthlog.sources.tables import for_owner, in_range, read_readings, read_rules, read_sensors, read_users
from hearthlog.sources.templates import default_templates
from hearthlog.streaming import jobs, keyed, series, windows

AS_OF = tables.AS_OF
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Show instants as UTC wall-clock values, so that results compare by value across engines."""
    return df.select(
        *[
            F.col(field.name).cast("timestamp_ntz").alias(field.name)
            if isinstance(field.dataType, T.TimestampType)
            else F.col(field.name)
            for field in df.schema
        ]
    )


def query(build: Query) -> Query:
    """Register ``build`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _plain(build(spark, sf_dir))

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Averages depend on the order of summation in their last digits."""
    return df.withColumns({name: F.round(name, 6) for name in columns})


# --- statistics -----------------------------------------------------------------------------------


@query
def daily_stats_7d(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.daily_statistics(tables.readings(spark, sf), tables.sensors(spark, sf), AS_OF), "value")


@query
def hourly_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.hourly_statistics(tables.readings(spark, sf), tables.sensors(spark, sf), AS_OF), "value")


@query
def hourly_json(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly series of every sensor as one JSON array, in the owner's unit."""
    sensors = tables.sensors(spark, sf)
    hours = stats.hourly_statistics(tables.readings(spark, sf), sensors, AS_OF)
    shown = _rounded(stats.in_owner_unit(hours, sensors, tables.users(spark, sf)), "value")
    return shown.groupBy("sensor_id", "local_date").agg(
        sinks.hourly_json(F.col("hour"), F.col("value")).alias("series_json")
    )


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    return stats.nested_statistics(
        tables.readings(spark, sf), tables.sensors(spark, sf), tables.users(spark, sf), AS_OF
    )


@query
def sensor_statistics_nested(spark: SparkSession, sf: str) -> DataFrame:
    nested = _nested(spark, sf).select(
        "sensor_id",
        "sensor_type",
        "unit_symbol",
        "today",
        stats.series_shape_ok(F.col("weekly"), F.col("hourly")).alias("shape_ok"),
        stats.has_data(F.col("sensor_type"), F.col("weekly")).alias("weekly_has_data"),
        stats.has_data(F.col("sensor_type"), F.col("hourly")).alias("hourly_has_data"),
        F.concat(
            F.transform(
                "weekly", lambda p: F.struct(p["date"].cast("string").alias("bucket"), p["value"].alias("value"))
            ),
            F.transform(
                "hourly", lambda p: F.struct(p["hour"].cast("string").alias("bucket"), p["value"].alias("value"))
            ),
        ).alias("points"),
    )
    flat = nested.select("*", F.inline("points")).drop("points")
    return _rounded(flat, "value")


@query
def rollup_15m(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.rollup_15m(tables.readings(spark, sf)), "sum_value")


@query
def local_day_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Instants between which each of a sensor's last seven local days lies."""
    day, zone = F.col("local_date"), F.col("zone")
    today = zones.local_date(F.lit(AS_OF).cast("timestamp"), zone)
    days = (
        stats.zoned(tables.sensors(spark, sf))
        .withColumn("today", today)
        .select("sensor_id", "zone", F.explode(F.sequence(F.date_sub("today", 6), F.col("today"))).alias("local_date"))
    )
    return days.select(
        "sensor_id",
        "local_date",
        zones.start_of_day(day, zone).alias("starts_at"),
        zones.start_of_day(F.date_add(day, 1), zone).alias("ends_at"),
    )


@query
def allowed_series_dates(spark: SparkSession, sf: str) -> DataFrame:
    """UTC dates with readings that may be opened as an hourly series at the reference instant."""
    dates = tables.readings(spark, sf).select("sensor_id", F.to_date("recorded_at").alias("date")).distinct()
    return stats.allowed_dates(dates, tables.sensors(spark, sf), AS_OF)


# --- recent values and lists ----------------------------------------------------------------------


@query
def recent_readings(spark: SparkSession, sf: str) -> DataFrame:
    shown = recent.recent_readings(tables.readings(spark, sf), tables.sensors(spark, sf), tables.users(spark, sf))
    return _rounded(shown, "numeric_value")


@query
def recent_from_days(spark: SparkSession, sf: str) -> DataFrame:
    """The latest readings from the stored table, of which only the days that some sensor needs are read."""
    path = f"{scratch_dir(spark)}/days-{uuid.uuid4().hex}"
    sinks.write_readings(tables.readings(spark, sf), path)
    stored = read_readings(spark, path)
    newest = recent.latest_of_days(stored, recent.day_counts(stored))
    shown = recent.recent_readings(newest, tables.sensors(spark, sf), tables.users(spark, sf))
    return _rounded(shown, "numeric_value")


def _bucketed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Readings and sensors, stored in buckets by sensor."""
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    readings = bucketed.write_readings(tables.readings(spark, sf), f"{name}_readings", f"{path}/readings", 8)
    return readings, bucketed.write_sensors(tables.sensors(spark, sf), f"{name}_sensors", f"{path}/sensors", 8)


@query
def bucketed_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The rollup of bucketed readings."""
    return _rounded(stats.rollup_15m(_bucketed(spark, sf)[0]), "sum_value")


@query
def bucketed_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The latest readings of bucketed tables."""
    shown = recent.recent_readings(*_bucketed(spark, sf), tables.users(spark, sf))
    return _rounded(shown, "numeric_value")


@query
def sensor_list(spark: SparkSession, sf: str) -> DataFrame:
    return recent.sensor_list(tables.sensors(spark, sf))


@query
def rule_list(spark: SparkSession, sf: str) -> DataFrame:
    ids = tables.sensor_ids(spark, sf)
    return _rounded(
        recent.rule_list(tables.rules(spark, sf, ids), tables.sensors(spark, sf, ids), tables.users(spark, sf)),
        "threshold_value",
    )


@query
def owner_counts(spark: SparkSession, sf: str) -> DataFrame:
    ids = tables.sensor_ids(spark, sf)
    return recent.owner_counts(
        tables.sensors(spark, sf, ids), tables.readings(spark, sf), tables.rules(spark, sf, ids)
    )


@query
def stored_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Write the fact table by day and read one week back; the scan prunes to the days of the week."""
    path = f"{scratch_dir(spark)}/readings-{uuid.uuid4().hex}"
    sinks.write_readings(tables.readings(spark, sf), path)
    return in_range(read_readings(spark, path), AS_OF.replace(day=22, hour=0), AS_OF.replace(day=29, hour=0))


@query
def stored_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Write the quarantine table, one folder per outcome, and read one outcome back."""
    path = f"{scratch_dir(spark)}/rejects-{uuid.uuid4().hex}"
    sinks.write_rejects(ingest.rejects(_classified(spark, sf)), path)
    return spark.read.parquet(path).where("outcome = 'INVALID_TOKEN_401'").select("request_id", "outcome")


@query
def stored_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Sensors, users and rules, written and scanned back with their declared schemas."""
    base = f"{scratch_dir(spark)}/dimensions-{uuid.uuid4().hex}"
    ids = tables.sensor_ids(spark, sf)
    written = {
        "sensors": (tables.sensors(spark, sf, ids), read_sensors),
        "app_users": (tables.users(spark, sf), read_users),
        "alert_rules": (tables.rules(spark, sf, ids), read_rules),
    }
    found = []
    for name, (df, read) in written.items():
        df.write.parquet(f"{base}/{name}")
        found.append(read(spark, f"{base}/{name}").select(F.lit(name).alias("table_name"), F.col("id").alias("row_id")))
    return functools.reduce(DataFrame.unionByName, found)


@query
def owner_sensors(spark: SparkSession, sf: str) -> DataFrame:
    """One owner's sensors."""
    return for_owner(tables.sensors(spark, sf), 3).select("id", "owner_id", "type")


@query
def unusable_zones(spark: SparkSession, sf: str) -> DataFrame:
    return stats.unusable_zones(tables.raw_sensors(spark, sf))


@query
def readings_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of one UTC week that count in statistics: canonical unit, or motion detected."""
    start = AS_OF.replace(day=22, hour=0)
    week = in_range(tables.readings(spark, sf), start, AS_OF.replace(day=29, hour=0))
    return week.where(F.col("unit").isin("C", "PERCENT") | F.col("boolean_value").eqNullSafe(F.lit(True)))


@query
def rule_form_sensors(spark: SparkSession, sf: str) -> DataFrame:
    """Which kind of rule each sensor can carry, and its canonical unit."""
    return tables.sensors(spark, sf).select(
        F.col("id").alias("sensor_id"),
        numbers.supports_numeric(F.col("type")).alias("numeric_rules"),
        (F.col("type") == "MOTION").alias("motion_rules"),
        numbers.canonical_unit(F.col("type")).alias("unit"),
    )


@query
def unit_conversions(spark: SparkSession, sf: str) -> DataFrame:
    """Each reading in every temperature unit, and back to Celsius."""
    value = F.col("numeric_value")
    celsius = tables.readings(spark, sf).where(F.col("unit") == "C")
    fahrenheit, kelvin = F.lit("FAHRENHEIT"), F.lit("KELVIN")
    return celsius.select(
        F.col("id").alias("reading_id"),
        F.round(units.from_celsius(value, F.lit(None).cast("string")), 6).alias("celsius"),
        F.round(units.from_celsius(value, fahrenheit), 6).alias("fahrenheit"),
        F.round(units.from_celsius(value, kelvin), 6).alias("kelvin"),
        F.round(units.to_celsius(value, fahrenheit), 6).alias("read_as_fahrenheit"),
        F.round(units.to_celsius(value, kelvin), 6).alias("read_as_kelvin"),
    )


# --- ingestion ------------------------------------------------------------------------------------


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.classify(tables.requests(spark, sf), tables.sensors(spark, sf))


@query
def ingest_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.outcome_counts(_classified(spark, sf))


@query
def accepted_readings(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.accepted_readings(_classified(spark, sf))


@query
def rejects(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.rejects(_classified(spark, sf))


@query
def last_seen(spark: SparkSession, sf: str) -> DataFrame:
    sensors = tables.sensors(spark, sf)
    classified = ingest.classify(tables.requests(spark, sf), sensors)
    seen = ingest.last_seen(sensors, ingest.accepted_readings(classified))
    return seen.select(F.col("id").alias("sensor_id"), "last_seen_at")


@query
def valid_measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Unchecked readings with the verdict of the range check for their sensor's type."""
    kind = tables.sensors(spark, sf).select(F.col("id").alias("sensor_id"), "type")
    return tables.raw_readings(spark, sf).join(kind, "sensor_id").select(
        F.col("id").alias("reading_id"),
        "sensor_id",
        numbers.valid_measurement(F.col("type"), F.col("numeric_value")).alias("valid"),
    )


@query
def normalized_emails(spark: SparkSession, sf: str) -> DataFrame:
    return tables.raw_users(spark, sf).select(
        F.col("id").alias("user_id"), text.normalized_email(F.col("email")).alias("email")
    )


# --- alerts ---------------------------------------------------------------------------------------


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.evaluate_alerts(tables.readings(spark, sf), tables.rules(spark, sf), tables.users(spark, sf))


@query
def active_rules(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.active_rules(tables.rules(spark, sf), tables.users(spark, sf)).select(
        F.col("id").alias("rule_id"), "owner_id", "sensor_id"
    )


@query
def alert_matches(spark: SparkSession, sf: str) -> DataFrame:
    matches = alerts.alert_matches(tables.readings(spark, sf), tables.rules(spark, sf), tables.users(spark, sf))
    return matches.drop("last_triggered_at")


@query
def rule_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every match of a fleet with two rules per sensor, in the order in which a reading's rules are evaluated."""
    rules = tables.rules(spark, sf)
    second = rules.withColumns({"id": F.col("id") + 1, "threshold_value": F.lit(35.0)})
    both = rules.unionByName(second)
    matches = alerts.alert_matches(tables.readings(spark, sf), both, tables.users(spark, sf))
    return alerts.in_rule_order(matches).select("reading_id", "rule_id", "place")


@query
def alerts_fired(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.fired(_evaluated(spark, sf))


@query
def alerts_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.suppressed_counts(_evaluated(spark, sf))


def _alert_events(spark: SparkSession, sf: str) -> DataFrame:
    ids, users = tables.sensor_ids(spark, sf), tables.users(spark, sf)
    rules, sensors = tables.rules(spark, sf, ids), tables.sensors(spark, sf, ids)
    fires = alerts.fired(alerts.evaluate_alerts(tables.readings(spark, sf), rules, users))
    return alerts.alert_events(fires, rules, sensors, users)


@query
def alert_events(spark: SparkSession, sf: str) -> DataFrame:
    """The nested event record, flattened."""
    return _alert_events(spark, sf).select(
        "rule_id",
        "reading_id",
        F.col("recipient.email").alias("recipient_email"),
        F.col("recipient.language").alias("recipient_language"),
        F.col("recipient.temperature_unit").alias("recipient_temperature_unit"),
        F.col("recipient.timezone").alias("recipient_timezone"),
        F.col("sensor.id").alias("sensor_id"),
        F.col("sensor.type").alias("sensor_type"),
        F.col("sensor.name").alias("sensor_name"),
        F.col("sensor.home_location").alias("sensor_home_location"),
        F.col("sensor.city").alias("sensor_city"),
        F.col("sensor.district").alias("sensor_district"),
        "recorded_at",
        "cooldown_minutes",
        F.col("trigger.comparison_operator").alias("comparison_operator"),
        F.col("trigger.reading_value").alias("reading_value"),
        F.col("trigger.threshold_value").alias("threshold_value"),
        F.col("trigger.unit").alias("unit"),
    )


@query
def rule_cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    """Each rule's last firing and whether it is still cooling down at the reference instant."""
    ids = tables.sensor_ids(spark, sf)
    rules = tables.rules(spark, sf, ids)
    fires = alerts.fired(alerts.evaluate_alerts(tables.readings(spark, sf), rules, tables.users(spark, sf)))
    last = fires.groupBy(F.col("rule_id").alias("id")).agg(F.max("recorded_at").alias("last_fired_at"))
    now = F.lit(AS_OF).cast("timestamp")
    return rules.join(last, "id", "left").select(
        F.col("id").alias("rule_id"),
        "last_fired_at",
        alerts.cooldown_active(F.col("last_fired_at"), F.col("cooldown_minutes"), now).alias("cooling_down"),
    )


@query
def rules_after_run(spark: SparkSession, sf: str) -> DataFrame:
    """When each rule last fired, as a batch run leaves it for the next one."""
    ids = tables.sensor_ids(spark, sf)
    rules = tables.rules(spark, sf, ids)
    fires = alerts.fired(alerts.evaluate_alerts(tables.readings(spark, sf), rules, tables.users(spark, sf)))
    return alerts.last_triggered(rules, fires).select(F.col("id").alias("rule_id"), "last_triggered_at")


@query
def alert_messages(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.alert_messages(_alert_events(spark, sf), default_templates(spark))


@query
def cap_per_window(spark: SparkSession, sf: str) -> DataFrame:
    """At most 20 requests per client and day, windows opening at their first request."""
    keyed = tables.code_requests(spark, sf).withColumn(
        "client_key", throttle.normalized_key(F.col("client_key"))
    )
    return throttle.cap_per_window(keyed, "client_key", "requested_at", "id", 1440, 20).select(
        "id", "client_key", "requested_at", "allowed"
    )


@query
def cap_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    """At most 2 requests per address and 20 per client and day; both caps are consumed."""
    return throttle.cap_two_keys(
        tables.code_requests(spark, sf),
        "address_key",
        "client_key",
        "requested_at",
        "id",
        address_limit=2,
        client_limit=20,
        width_minutes=1440,
    ).select("id", "address_key", "client_key", "address_allowed", "client_allowed", "allowed")


# --- table health ---------------------------------------------------------------------------------


@query
def quality_violations(spark: SparkSession, sf: str) -> DataFrame:
    sensors, rules = tables.sensors(spark, sf), tables.raw_rules(spark, sf)
    verifications, resets = tables.challenges(spark, sf), tables.reset_challenges(spark, sf)
    checks = [
        ("sensor_readings", tables.raw_readings(spark, sf), quality.reading_checks(), schema.READINGS),
        ("alert_rules", rules, quality.rule_checks(), schema.RULES),
        ("sensors", tables.raw_sensors(spark, sf), quality.sensor_checks(), schema.SENSORS),
        ("app_users", tables.raw_users(spark, sf), quality.user_checks(), schema.USERS),
        ("email_verification_challenges", verifications, quality.challenge_checks(), schema.CHALLENGES),
        ("password_reset_challenges", resets, quality.challenge_checks(), schema.CHALLENGES),
    ]
    found = [
        quality.violations(df, name, {**own, **quality.required(layout, df)}) for name, df, own, layout in checks
    ]
    return functools.reduce(DataFrame.unionByName, [*found, quality.rule_sensor_violations(rules, sensors)])


@query
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    users, sensors = tables.raw_users(spark, sf), tables.raw_sensors(spark, sf)
    verifications, resets = tables.challenges(spark, sf), tables.reset_challenges(spark, sf)
    stored = {
        "app_users": users,
        "sensors": sensors,
        "alert_rules": tables.raw_rules(spark, sf),
        "sensor_readings": tables.raw_readings(spark, sf),
        "email_verification_challenges": verifications,
        "password_reset_challenges": resets,
    }
    return quality.duplicate_keys(stored)


@query
def taken_on_write(spark: SparkSession, sf: str) -> DataFrame:
    """Every third sensor as a new batch: whose token is in use already, in the table or in the batch."""
    token, bits = F.col("ingestion_token_hash"), 1 << 20
    registry = tables.raw_sensors(spark, sf).select("id", "ingestion_token_hash")
    stored, batch = registry.where("id % 3 <> 0"), registry.where("id % 3 = 0")
    known = key_filter.build(stored, token, bits)
    return key_filter.taken_keys(batch, stored, token, known, bits).select("id", "key_value")


@query
def missing_on_write(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of a new batch that refer to no stored sensor."""
    sensors, bits = tables.sensors(spark, sf), 1 << 20
    known = key_filter.merge(*[key_filter.build(sensors.where(half), F.col("id"), bits) for half in ("active", "NOT active")])
    rules = tables.raw_rules(spark, sf).select("id", "sensor_id")
    missing = key_filter.missing_references(rules, sensors, "sensor_id", known, bits)
    return missing.select(F.col("id").alias("rule_id"), "sensor_id")


@query
def name_taken(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the unchecked sensor table whose name another sensor of the owner already has."""
    registry = tables.raw_sensors(spark, sf)
    return quality.name_taken(registry.select("id", "owner_id", "name"), registry)


@query
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    sensors, users = tables.sensors(spark, sf), tables.users(spark, sf)
    checked_rules = tables.raw_rules(spark, sf)
    found = quality.orphans(checked_rules, sensors, "sensor_id", "alert_rules")
    for more in (
        quality.orphans(checked_rules, users, "owner_id", "alert_rules"),
        quality.orphans(tables.raw_sensors(spark, sf), users, "owner_id", "sensors"),
        quality.orphans(tables.readings(spark, sf), tables.raw_sensors(spark, sf), "sensor_id", "sensor_readings"),
        quality.orphans(tables.challenges(spark, sf), users, "user_id", "email_verification_challenges"),
        quality.orphans(tables.reset_challenges(spark, sf), users, "user_id", "password_reset_challenges"),
    ):
        found = found.unionByName(more)
    return found


@query
def rule_owner_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rule_owner_mismatch(tables.raw_rules(spark, sf), tables.sensors(spark, sf))


@query
def canonical_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        quality.canonical_rules(tables.rule_forms(spark, sf), tables.sensors(spark, sf), tables.users(spark, sf)),
        "threshold_value",
    )


@query
def retained_readings(spark: SparkSession, sf: str) -> DataFrame:
    return retention.retained_readings(tables.readings(spark, sf), AS_OF)


@query
def retained_challenges(spark: SparkSession, sf: str) -> DataFrame:
    """Both challenge tables after the purge of everything that has expired."""
    verifications = tables.challenges(spark, sf).withColumn("table_name", F.lit("email_verification_challenges"))
    resets = tables.reset_challenges(spark, sf).withColumn("table_name", F.lit("password_reset_challenges"))
    return retention.retained_challenges(verifications.unionByName(resets), AS_OF)


@query
def after_sensor_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What is left once all inactive sensors are deleted, with their readings and rules."""
    ids = tables.sensor_ids(spark, sf)
    sensors, checked_rules = tables.sensors(spark, sf, ids), tables.rules(spark, sf, ids)
    left = retention.delete_sensors(
        sensors, tables.raw_readings(spark, sf), checked_rules, sensors.where(~F.col("active"))
    )
    named = [
        df.select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"))
        for name, df in zip(("sensors", "sensor_readings", "alert_rules"), left)
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query
def readings_after_file_delete(spark: SparkSession, sf: str) -> DataFrame:
    """The stored fact table after every fifth sensor's readings were deleted file by file."""
    path = f"{scratch_dir(spark)}/deleted-{uuid.uuid4().hex}"
    sinks.write_readings(tables.readings(spark, sf), path)
    retention.delete_sensor_files(spark, path, tables.sensors(spark, sf).where("id % 5 = 1"))
    return read_readings(spark, path).drop("recorded_date")


@query
def retained_files(spark: SparkSession, sf: str) -> DataFrame:
    """The stored fact table after the purge, which removes files of old days and rewrites those of one day."""
    path = f"{scratch_dir(spark)}/purged-{uuid.uuid4().hex}"
    sinks.write_readings(tables.readings(spark, sf), path)
    retention.purge_files(spark, path, AS_OF)
    return read_readings(spark, path).drop("recorded_date")


@query
def after_user_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What is left once all users without a verified address are deleted, with all that is theirs."""
    ids = tables.sensor_ids(spark, sf)
    users = tables.users(spark, sf)
    left = retention.delete_users(
        {
            "app_users": users,
            "sensors": tables.sensors(spark, sf, ids),
            "sensor_readings": tables.raw_readings(spark, sf),
            "alert_rules": tables.rules(spark, sf, ids),
            "email_verification_challenges": tables.challenges(spark, sf),
            "password_reset_challenges": tables.reset_challenges(spark, sf),
        },
        users.where(F.col("email_verified_at").isNull()),
    )
    named = [df.select(F.lit(name).alias("table_name"), F.col("id").alias("row_id")) for name, df in left.items()]
    return functools.reduce(DataFrame.unionByName, named)


# --- text -----------------------------------------------------------------------------------------


@query
def metric_labels(spark: SparkSession, sf: str) -> DataFrame:
    sensors = tables.sensors(spark, sf)
    daily = _rounded(stats.daily_statistics(tables.readings(spark, sf), sensors, AS_OF), "value")
    return labels.daily_labels(daily, sensors, tables.users(spark, sf))


_BUCKETS = {"weekly": "date", "hourly": "hour"}


@query
def statistics_table(spark: SparkSession, sf: str) -> DataFrame:
    settled = lambda key: F.transform(
        key, lambda p: F.struct(p[_BUCKETS[key]].alias(_BUCKETS[key]), F.round(p["value"], 6).alias("value"))
    )
    nested = _nested(spark, sf).withColumns({key: settled(key) for key in _BUCKETS})
    return labels.statistics_table(nested)


@query
def zone_labels(spark: SparkSession, sf: str) -> DataFrame:
    ids = tables.users(spark, sf).select(F.col("preferred_timezone").alias("zone"))
    return labels.zone_labels(ids, AS_OF)


@query
def calibrate_adc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(feeds.calibrated(tables.adc_samples(spark, sf)), "celsius")


@query
def lenient_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.lenient_values(tables.text_feed(spark, sf)).select("id", "motion", "number")


# --- streams, run to completion -------------------------------------------------------------------


def _run_folder(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _stream_readings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.as_readings(tables.stream_events(spark, sf))


def _arriving(spark: SparkSession, df: DataFrame, parts: list[Column]) -> Iterator[DataFrame]:
    """The feed as a stream, each time after one more part of ``df`` has arrived."""
    feed = f"{scratch_dir(spark)}/feed-{uuid.uuid4().hex}"
    for part in parts:
        df.where(part).write.mode("append").parquet(feed)
        yield spark.readStream.schema(df.schema).parquet(feed)


def _thirds(time: str) -> list[Column]:
    """The first ten days of January, the next ten and the rest."""
    at = [F.col(time) < F.lit(day).cast("timestamp") for day in ("2024-01-11", "2024-01-21")]
    return [at[0], ~at[0] & at[1], ~at[1]]


@query
def stream_cooldown_state(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts by keyed state; the query is stopped and resumed from its checkpoint twice."""
    out, checkpoint = _run_folder(spark, "keyed")
    for stream in _arriving(spark, tables.readings(spark, sf), _thirds("recorded_at")):
        rules, users = tables.rules(spark, sf), tables.users(spark, sf)
        keyed.stream_cooldown(stream, rules, users, out, checkpoint, available_now=True).awaitTermination()
    return jobs.read_outbox(spark, out)


def _write_logs(requests: DataFrame, path: str) -> None:
    """Append ``requests`` to the folder ``path`` as log files of lines."""
    line = request_log.log_line(*[F.col(c) for c in ("request_id", "received_at", "path", "body")])
    requests.select(line.alias("value")).write.mode("append").text(path)


@query
def outcomes_from_log(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of the requests of a text log, read in byte ranges."""
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    _write_logs(tables.requests(spark, sf), path)
    read = request_log.read_request_log(spark, path, range_bytes=1 << 18)
    return ingest.outcome_counts(ingest.classify(read, tables.sensors(spark, sf)))


@query
def stream_log_to_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """From the text log to the alert sink in one stream: parse, classify, match, cool down, commit."""
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    out, checkpoint = _run_folder(spark, "sink")
    _write_logs(tables.requests(spark, sf), path)
    sensors, rules, users = tables.sensors(spark, sf), tables.rules(spark, sf), tables.users(spark, sf)
    classified = ingest.classify(request_log.stream_request_log(spark, path), sensors)
    evaluated = keyed.cooldown(ingest.accepted_readings(classified), rules, users)
    alert_sink.write_alert_stream(alerts.fired(evaluated), out, checkpoint, available_now=True).awaitTermination()
    return alert_sink.read_alert_sink(spark, out)


@query
def stream_cap_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The two caps over an arriving feed, stopped and resumed twice; windows that ended leave the state."""
    out, checkpoint = _run_folder(spark, "caps")
    for stream in _arriving(spark, tables.code_requests(spark, sf), _thirds("requested_at")):
        keyed.stream_caps(
            stream, out, checkpoint, address_limit=2, client_limit=20, width_minutes=1440, available_now=True
        ).awaitTermination()
    return keyed.read_verdicts(spark, out).drop("requested_at")


def _late_thirds() -> list[Column]:
    """Every fifth reading of the first third arrives with the last one, ten days late."""
    late = F.col("id") % 5 == 0
    first, second, third = _thirds("recorded_at")
    return [first & ~late, second, third | (first & late)]


@query
def stream_slots_late(spark: SparkSession, sf: str) -> DataFrame:
    """Event-time slots of a feed with late readings: closed slots, corrections and what is still open."""
    out, checkpoint = _run_folder(spark, "slots")
    for stream in _arriving(spark, tables.readings(spark, sf), _late_thirds()):
        windows.stream_windows(stream, out, checkpoint, available_now=True).awaitTermination()
    return _rounded(windows.slots_so_far(spark, out, checkpoint), "sum_value")


@query
def stream_daily_series(spark: SparkSession, sf: str) -> DataFrame:
    """Seven-day statistics from the cells that a stream keeps, late readings included."""
    out, checkpoint = _run_folder(spark, "series")
    sensors = tables.sensors(spark, sf)
    for stream in _arriving(spark, tables.readings(spark, sf), _late_thirds()):
        series.stream_series(stream, lambda: sensors, out, checkpoint, available_now=True).awaitTermination()
    return _rounded(series.daily_series(spark, out, sensors, AS_OF), "value")


@query
def stream_hourly_series(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of the current day from the cells that a stream keeps."""
    out, checkpoint = _run_folder(spark, "series")
    sensors = tables.sensors(spark, sf)
    stream = _stream_readings(spark, sf)
    series.stream_series(stream, lambda: sensors, out, checkpoint, available_now=True).awaitTermination()
    return _rounded(series.hourly_series(spark, out, sensors, AS_OF), "value")


@query
def stream_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The latest readings kept by a stream over the first two thirds, merged with a batch of the rest."""
    out, checkpoint = _run_folder(spark, "latest")
    first, second, third = _thirds("recorded_at")
    for stream in _arriving(spark, tables.readings(spark, sf), [second, first]):
        jobs.stream_latest(stream, out, checkpoint, available_now=True).awaitTermination()
    rest = recent.merge_latest(tables.readings(spark, sf).where(third))
    newest = recent.merge_latest(jobs.read_latest(spark, out), rest)
    shown = recent.recent_readings(newest, tables.sensors(spark, sf), tables.users(spark, sf))
    return _rounded(shown, "numeric_value")


@query
def compacted_with_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Compaction into a fact table that holds every other reading of the same days, less a few deleted sensors."""
    out, checkpoint = _run_folder(spark, "merged")
    sensors, gone = tables.sensors(spark, sf), tables.sensors(spark, sf).where("id % 5 = 1")
    sinks.write_readings(tables.readings(spark, sf).where("id % 2 = 0"), f"{out}/fact")
    retention.delete_sensor_files(spark, f"{out}/fact", gone)
    requests = tables.as_requests(tables.stream_events(spark, sf))
    # The feed brings two thirds of all readings, some of them stored already, deleted sensors included.
    part = requests.where("request_id % 3 <> 0")
    jobs.stream_ingest(part, lambda: sensors, out, checkpoint, available_now=True).awaitTermination()
    for _ in range(2):
        jobs.compact_readings(spark, out, f"{out}/fact", dt.date(2023, 12, 1), dt.date(2024, 3, 1), gone)
    return read_readings(spark, f"{out}/fact").drop("recorded_date")


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Readings written by the streaming ingestion."""
    out, checkpoint = _run_folder(spark, "ingest")
    requests = tables.as_requests(tables.stream_events(spark, sf))
    run = jobs.stream_ingest(requests, lambda: tables.sensors(spark, sf), out, checkpoint, available_now=True)
    run.awaitTermination()
    return read_readings(spark, f"{out}/readings").drop("run", "epoch", "recorded_date")


@query
def stream_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table after two queries streamed the same feed and their days were compacted, twice."""
    out, checkpoint = _run_folder(spark, "compacted")
    requests = tables.as_requests(tables.stream_events(spark, sf))
    for part in ("a", "b"):
        run = jobs.stream_ingest(
            requests, lambda: tables.sensors(spark, sf), out, f"{checkpoint}-{part}", available_now=True
        )
        run.awaitTermination()
    for _ in range(2):
        jobs.compact_readings(spark, out, f"{out}/fact", dt.date(2023, 12, 1), dt.date(2024, 3, 1))
    return read_readings(spark, f"{out}/fact").drop("recorded_date")


@query
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts fired by the streaming evaluation."""
    out, checkpoint = _run_folder(spark, "alerts")
    run = jobs.stream_alerts(
        _stream_readings(spark, sf),
        lambda: tables.rules(spark, sf),
        lambda: tables.users(spark, sf),
        out,
        checkpoint,
        available_now=True,
    )
    run.awaitTermination()
    return jobs.read_outbox(spark, out)


@query
def stream_alerts_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The feed in two halves, the second by a query with a checkpoint of its own."""
    out, checkpoint = _run_folder(spark, "resumed")
    middle = F.lit("2024-01-16").cast("timestamp")
    readings = _stream_readings(spark, sf)
    for part, half in (("a", F.col("recorded_at") < middle), ("b", F.col("recorded_at") >= middle)):
        run = jobs.stream_alerts(
            readings.where(half),
            lambda: tables.rules(spark, sf),
            lambda: tables.users(spark, sf),
            out,
            f"{checkpoint}-{part}",
            available_now=True,
        )
        run.awaitTermination()
    return jobs.read_outbox(spark, out)


@query
def daily_from_stored_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Seven-day statistics answered from the stored rollup; every fourth sensor is off the grid."""
    out, checkpoint = _run_folder(spark, "stored")
    zone = F.when(F.col("id") % 4 == 1, F.lit("+01:07")).otherwise(F.col("time_zone_id"))
    sensors = tables.sensors(spark, sf).withColumn("time_zone_id", zone)
    jobs.stream_rollup(
        _stream_readings(spark, sf), out, checkpoint, available_now=True, sensors=lambda: sensors
    ).awaitTermination()
    stored = stats.slots_around(jobs.read_rollup(spark, out), AS_OF)
    return _rounded(stats.daily_from_rollup(stored, sensors, AS_OF), "value")


@query
def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Rollup kept by the streaming job."""
    out, checkpoint = _run_folder(spark, "rollup")
    jobs.stream_rollup(_stream_readings(spark, sf), out, checkpoint, available_now=True).awaitTermination()
    return _rounded(jobs.read_rollup(spark, out), "sum_value")
