"""Table invariants as data: every broken rule of every row, in one pass per table.

A check that evaluates to NULL counts as kept, as an SQL CHECK constraint does; nulls in required
columns are found by checks of their own.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog import schema
from hearthlog.functions import numbers, text, units


def _blank(column: str) -> Column:
    return F.trim(F.col(column)) == ""


def _not_blank(column: str) -> Column:
    return ~_blank(column)


def _null_or(column: str, allowed: tuple[str, ...]) -> Column:
    return F.col(column).isNull() | F.col(column).isin(*allowed)


def _null_or_finite(column: str) -> Column:
    return F.col(column).isNull() | numbers.is_finite(F.col(column))


def _unless_unit(unit_column: str, unit: str, check: Column) -> Column:
    return ~F.col(unit_column).eqNullSafe(F.lit(unit)) | check


def _above_zero(column: str) -> Column:
    # NaN sorts above every number in both comparisons, here and in the oracle.
    return F.col(column) >= F.lit(schema.ABSOLUTE_ZERO_C)


def _percentage(column: str) -> Column:
    return F.col(column).between(F.lit(schema.HUMIDITY_MIN), F.lit(schema.HUMIDITY_MAX))


def reading_checks() -> dict[str, Column]:
    number, flag, unit = (F.col(name).isNotNull() for name in ("numeric_value", "boolean_value", "unit"))
    return {
        "value_shape": (number & ~flag & unit) | (~number & flag & ~unit),
        "unit_known": _null_or("unit", schema.MEASUREMENT_UNITS),
        "numeric_finite": _null_or_finite("numeric_value"),
        "temperature_range": _unless_unit("unit", "C", _above_zero("numeric_value")),
        "humidity_range": _unless_unit("unit", "PERCENT", _percentage("numeric_value")),
    }


def rule_checks() -> dict[str, Column]:
    compared, value, unit, event = (
        F.col(name).isNotNull()
        for name in ("comparison_operator", "threshold_value", "threshold_unit", "event_type")
    )
    numeric = (F.col("rule_type") == "NUMERIC_THRESHOLD") & compared & value & unit & _not_blank("threshold_unit") & ~event
    detected = (F.col("rule_type") == "EVENT_DETECTED") & event & ~compared & ~value & ~unit
    return {
        "rule_type_known": F.col("rule_type").isin(*schema.RULE_TYPES),
        "operator_known": _null_or("comparison_operator", schema.COMPARISON_OPERATORS),
        "event_known": _null_or("event_type", schema.EVENT_TYPES),
        "rule_shape": numeric | detected,
        "cooldown_range": F.col("cooldown_minutes").between(
            schema.COOLDOWN_MIN_MINUTES, schema.COOLDOWN_MAX_MINUTES
        ),
        "threshold_unit_known": _null_or("threshold_unit", schema.MEASUREMENT_UNITS),
        "threshold_finite": _null_or_finite("threshold_value"),
        "threshold_temperature_range": _unless_unit("threshold_unit", "C", _above_zero("threshold_value")),
        "threshold_humidity_range": _unless_unit("threshold_unit", "PERCENT", _percentage("threshold_value")),
    }


# Longest texts the columns hold.
_SENSOR_LENGTHS = {
    "type": 40, "name": 100, "city": 100, "district": 100, "home_location": 100, "time_zone_id": 64,
    "ingestion_token_hash": 64,
}
_USER_LENGTHS = {
    "email": 320, "preferred_language": 30, "preferred_temperature_unit": 30, "preferred_timezone": 64,
}


def _lengths(limits: dict[str, int]) -> dict[str, Column]:
    return {f"{name}_length": F.length(name) <= limit for name, limit in limits.items()}


def sensor_checks() -> dict[str, Column]:
    texts = ("name", "city", "district", "home_location", "time_zone_id")
    return {
        "type_known": F.col("type").isin(*schema.SENSOR_TYPES),
        **{f"{name}_not_blank": _not_blank(name) for name in texts},
        **_lengths(_SENSOR_LENGTHS),
    }


def user_checks() -> dict[str, Column]:
    return {
        "email_not_blank": _not_blank("email"),
        "timezone_not_blank": _not_blank("preferred_timezone"),
        "language_known": F.col("preferred_language").isin(*schema.LANGUAGES),
        "temperature_unit_known": F.col("preferred_temperature_unit").isin(*schema.TEMPERATURE_UNITS),
        "verified_after_creation": F.col("email_verified_at").isNull()
        | (F.col("email_verified_at") >= F.col("created_at")),
        **_lengths(_USER_LENGTHS),
    }


def challenge_checks() -> dict[str, Column]:
    at = F.col
    return {
        "code_not_blank": _not_blank("code_hash"),
        "attempts_not_negative": at("failed_attempts") >= 0,
        "issued_after_creation": at("issued_at") >= at("created_at"),
        "expires_after_issue": at("expires_at") > at("issued_at"),
        "resend_window": (at("resend_available_at") >= at("issued_at"))
        & (at("resend_available_at") < at("expires_at")),
        "updated_after_creation": at("updated_at") >= at("created_at"),
    }


def required(layout: T.StructType, df: DataFrame) -> dict[str, Column]:
    """NOT NULL rules: one check per column of ``df`` that ``layout`` declares as not nullable."""
    names = [f.name for f in layout.fields if not f.nullable and f.name in df.columns]
    return {f"{name}_required": F.col(name).isNotNull() for name in names}


def violations(df: DataFrame, table: str, checks: dict[str, Column], key: str = "id") -> DataFrame:
    """One row ``(table_name, rule, row_id)`` per broken check; one scan, no exchange.

    Every row gives one cell per check, empty where the check holds; the empty cells are dropped right
    behind the explode. That keeps each check evaluated once and everything in generated code, which
    neither a predicate over all checks nor an array function in front of the explode would.
    """
    cells = [F.when(~F.coalesce(kept, F.lit(True)), F.lit(rule)) for rule, kept in checks.items()]
    exploded = df.select(
        F.lit(table).alias("table_name"), F.explode(F.array(*cells)).alias("rule"), F.col(key).alias("row_id")
    )
    return exploded.where(F.col("rule").isNotNull())


def rule_sensor_violations(rules: DataFrame, sensors: DataFrame) -> DataFrame:
    """Checks of a rule against its sensor: kind of rule, unit, and owner."""
    owned = sensors.select(
        F.col("id").alias("sensor_id"), F.col("type").alias("sensor_type"), F.col("owner_id").alias("sensor_owner")
    )
    numeric = F.col("rule_type") == "NUMERIC_THRESHOLD"
    event = F.col("rule_type") == "EVENT_DETECTED"
    return violations(
        rules.join(owned, "sensor_id"),
        "alert_rules",
        {
            "numeric_rule_needs_numeric_sensor": ~numeric | numbers.supports_numeric(F.col("sensor_type")),
            "unit_matches_sensor": ~numeric
            | F.col("threshold_unit").eqNullSafe(numbers.canonical_unit(F.col("sensor_type"))),
            "event_rule_needs_motion_sensor": ~event | (F.col("sensor_type") == "MOTION"),
            "owner_matches_sensor": F.col("owner_id") == F.col("sensor_owner"),
        },
    )


def rule_owner_mismatch(rules: DataFrame, sensors: DataFrame) -> DataFrame:
    """Rules whose owner does not own the sensor."""
    owned = sensors.select(F.col("id").alias("sensor_id"), F.col("owner_id").alias("sensor_owner_id"))
    return (
        rules.join(owned, "sensor_id")
        .where(F.col("owner_id") != F.col("sensor_owner_id"))
        .select(F.col("id").alias("rule_id"), "sensor_id", "owner_id", "sensor_owner_id")
    )


Keys = dict[str, tuple[Column, ...]]


def unique_keys() -> dict[str, Keys]:
    """The unique keys of every table of the data model, by rule; ``primary_key`` included."""
    user = {"user_id": (F.col("user_id"),)}
    own: dict[str, Keys] = {
        "app_users": {"email": (F.lower("email"),)},
        "sensors": {"owner_name": (F.col("owner_id"), F.lower("name")), "token_hash": (F.col("ingestion_token_hash"),)},
        "alert_rules": {},
        "sensor_readings": {},
        "email_verification_challenges": user,
        "password_reset_challenges": user,
    }
    return {table: {**keys, "primary_key": (F.col("id"),)} for table, keys in own.items()}


def key_values(df: DataFrame, keys: Keys) -> DataFrame:
    """(rule, key_value) of every row and key in one pass; keys with a NULL part are left out."""
    entries = []
    for rule, parts in keys.items():
        text_parts = [part.cast("string") for part in parts]
        whole = functools.reduce(operator.and_, [part.isNotNull() for part in text_parts])
        value = F.when(whole, F.concat_ws("|", *text_parts))
        entries.append(F.struct(F.lit(rule).alias("rule"), value.alias("key_value")))
    return df.select(F.inline(F.array(*entries))).where(F.col("key_value").isNotNull())


def duplicate_keys(stored: dict[str, DataFrame], keys: dict[str, Keys] | None = None) -> DataFrame:
    """Key values held by more than one row of the named tables, a batch appended twice for example.

    Each table is scanned once for all of its keys, and all tables share one exchange. Counting combines on
    the map side, so a very frequent key costs one partial row per task.
    """
    keys = keys or unique_keys()
    found = [
        key_values(df, keys[table]).select(F.lit(table).alias("table_name"), "rule", "key_value")
        for table, df in stored.items()
    ]
    counted = functools.reduce(DataFrame.unionByName, found).groupBy("table_name", "rule", "key_value")
    return counted.agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def name_taken(candidates: DataFrame, sensors: DataFrame) -> DataFrame:
    """Candidate names their owner already uses for another sensor, case ignored.

    ``candidates`` holds (id, owner_id, name); ``id`` is NULL for a sensor yet to be created. The
    table is reduced to one row per owner and name first, so a name used very often is one row.
    """
    folded = F.lower(text.trim_controls(F.col("name")))
    held = (
        sensors.groupBy(F.col("owner_id").alias("held_owner"), folded.alias("held_name"))
        .agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    )
    same = F.col("first_id").eqNullSafe(F.col("id")) & F.col("last_id").eqNullSafe(F.col("id"))
    return (
        candidates.withColumn("folded", folded)
        .join(
            held,
            (F.col("owner_id") == F.col("held_owner")) & (F.col("folded") == F.col("held_name")) & ~same,
            "left_semi",
        )
        .drop("folded")
    )


def orphans(child: DataFrame, parent: DataFrame, reference: str, table: str) -> DataFrame:
    """Rows whose non-null reference points at no parent row."""
    keys = parent.select(F.col("id").alias(reference))
    return (
        child.where(F.col(reference).isNotNull())
        .join(keys, reference, "left_anti")
        .select(
            F.lit(table).alias("table_name"),
            F.lit(reference).alias("reference"),
            F.col("id").alias("row_id"),
            F.col(reference).alias("missing_id"),
        )
    )


def canonical_rules(forms: DataFrame, sensors: DataFrame, users: DataFrame) -> DataFrame:
    """Submitted rule definitions in stored form, each with ``status``.

    The threshold goes from the owner's unit to the canonical one; the unit follows from the sensor
    type. ``status`` is OK or the first reason to quarantine the row.
    """
    owned = sensors.select(
        F.col("id").alias("sensor_id"), F.col("owner_id").alias("sensor_owner"), F.col("type").alias("sensor_type")
    )
    owners = users.select(F.col("id").alias("owner_id"), F.col("preferred_temperature_unit").alias("unit"))
    kind, numeric = F.col("sensor_type"), F.col("rule_type") == "NUMERIC_THRESHOLD"
    canonical = F.when(kind == "TEMPERATURE", units.to_celsius(F.col("threshold_value"), F.col("unit"))).otherwise(
        F.col("threshold_value")
    )
    complete = F.col("cooldown_minutes").isNotNull() & (
        ~numeric
        | (F.col("comparison_operator").isNotNull() & numbers.is_finite(F.col("threshold_value")))
    )
    cooldown_ok = numbers.int_between(
        F.col("cooldown_minutes"), schema.COOLDOWN_MIN_MINUTES, schema.COOLDOWN_MAX_MINUTES
    )
    status = (
        F.when(~(complete & cooldown_ok), "INVALID_FORM")
        .when(~F.col("owner_id").eqNullSafe(F.col("sensor_owner")), "SENSOR_NOT_OWNED")
        .when(numeric & ~numbers.supports_numeric(kind), "WRONG_SENSOR_TYPE")
        .when(~numeric & (kind != "MOTION"), "WRONG_SENSOR_TYPE")
        .when(numeric & ~numbers.valid_measurement(kind, F.col("canonical")), "THRESHOLD_OUT_OF_RANGE")
        .otherwise("OK")
    )
    stored = lambda column: F.when((F.col("status") == "OK") & numeric, column)
    return (
        forms.join(owned, "sensor_id", "left")
        .join(owners, "owner_id", "left")
        .withColumn("canonical", canonical)
        .withColumn("status", status)
        .select(
            "form_id",
            "owner_id",
            "sensor_id",
            "rule_type",
            stored(F.col("comparison_operator")).alias("comparison_operator"),
            stored(F.col("canonical")).alias("threshold_value"),
            stored(numbers.canonical_unit(kind)).alias("threshold_unit"),
            F.when((F.col("status") == "OK") & ~numeric, F.lit("MOTION_DETECTED")).alias("event_type"),
            "cooldown_minutes",
            "status",
        )
    )
