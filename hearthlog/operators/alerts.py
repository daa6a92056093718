"""Alert rules over readings: match, cooldown, event record, message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions import display, text, units, zones
from hearthlog.operators import throttle
from hearthlog.sources.templates import bundles


def active_rules(rules: DataFrame, users: DataFrame) -> DataFrame:
    """Enabled rules whose owner has a verified address."""
    verified = users.where(F.col("email_verified_at").isNotNull()).select(
        F.col("id").alias("owner_id"), "email_verified_at"
    )
    return rules.where("enabled").join(verified, "owner_id")


def comparison_holds(operator: Column, value: Column, threshold: Column) -> Column:
    """Strict comparison; a NULL or NaN on either side never matches."""
    usable = value.isNotNull() & threshold.isNotNull() & ~F.isnan(value) & ~F.isnan(threshold)
    holds = F.when(operator == "ABOVE", value > threshold).when(operator == "BELOW", value < threshold)
    return usable & F.coalesce(holds, F.lit(False))


def cooldown_active(last: Column, minutes: Column, at: Column) -> Column:
    """TRUE while a rule may not fire again; at the very end it may."""
    end = last + F.make_dt_interval(mins=minutes)
    return F.coalesce(end > at, F.lit(False))


def alert_matches(readings: DataFrame, rules: DataFrame, users: DataFrame) -> DataFrame:
    """Every (rule, reading) pair in which the reading triggers the rule.

    An equi-join on the sensor whose remaining condition is the rule itself, so only matching pairs
    leave the join. A replay of old readings does not fire rules that did not exist, or whose owner
    was not verified, at the time.
    """
    definitions = active_rules(rules, users).select(
        F.col("id").alias("rule_id"),
        F.col("sensor_id").alias("rule_sensor_id"),
        "rule_type",
        "comparison_operator",
        "threshold_value",
        "threshold_unit",
        "event_type",
        "cooldown_minutes",
        "last_triggered_at",
        F.greatest("created_at", "email_verified_at").alias("effective_from"),
    )
    facts = readings.where(F.col("numeric_value").isNotNull() | F.col("boolean_value")).select(
        F.col("id").alias("reading_id"), "sensor_id", "numeric_value", "boolean_value", "unit", "recorded_at"
    )
    numeric = (
        (F.col("rule_type") == "NUMERIC_THRESHOLD")
        & F.col("boolean_value").isNull()
        & (F.col("unit") == F.col("threshold_unit"))
        & comparison_holds(F.col("comparison_operator"), F.col("numeric_value"), F.col("threshold_value"))
    )
    event = (
        (F.col("rule_type") == "EVENT_DETECTED")
        & (F.col("event_type") == "MOTION_DETECTED")
        & F.col("numeric_value").isNull()
        & F.col("unit").isNull()
        & F.col("boolean_value")
    )
    return facts.join(
        definitions,
        (F.col("sensor_id") == F.col("rule_sensor_id"))
        & (F.col("recorded_at") >= F.col("effective_from"))
        & (numeric | event),
    ).select(
        "rule_id",
        "reading_id",
        "sensor_id",
        "recorded_at",
        "numeric_value",
        "cooldown_minutes",
        "last_triggered_at",
    )


def in_rule_order(matches: DataFrame) -> DataFrame:
    """Matches with ``place``: the order in which a reading's rules are evaluated, by rule id from 1 on."""
    by_rule = Window.partitionBy("reading_id").orderBy("rule_id")
    return matches.withColumn("place", F.row_number().over(by_rule))


def cooldown(matches: DataFrame, **sizes: int) -> DataFrame:
    """Matches with ``fired``: a rule fires unless it fired less than its cooldown ago.

    A suppressed match does not extend the cooldown; ``last_triggered_at`` seeds it. Rules are
    independent of each other, so their order within a reading does not matter.
    """
    return throttle.cap_per_window(
        matches,
        key="rule_id",
        time="recorded_at",
        event_id="reading_id",
        width_minutes=F.col("cooldown_minutes"),
        limit=1,
        flag="fired",
        last_admitted=F.col("last_triggered_at"),
        **sizes,
    )


def evaluate_alerts(readings: DataFrame, rules: DataFrame, users: DataFrame) -> DataFrame:
    """Matches of accepted readings, each marked fired or suppressed."""
    return cooldown(alert_matches(readings, rules, users))


def fired(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("fired").select("rule_id", "reading_id", "sensor_id", "recorded_at", "numeric_value")


def last_triggered(rules: DataFrame, fires: DataFrame) -> DataFrame:
    """The rules with ``last_triggered_at`` moved forward to their newest firing.

    Store them after every batch run: a run over the next readings then starts from the state this one
    leaves, and two half-runs fire what one run fires.
    """
    newest = fires.groupBy(F.col("rule_id").alias("id")).agg(F.max("recorded_at").alias("newest"))
    moved = F.greatest("last_triggered_at", "newest")
    return rules.join(newest, "id", "left").withColumn("last_triggered_at", moved).select(*rules.columns)


def suppressed_counts(evaluated: DataFrame) -> DataFrame:
    """Matches per rule that its cooldown suppressed."""
    return evaluated.where(~F.col("fired")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_suppressed"))


def alert_events(fires: DataFrame, rules: DataFrame, sensors: DataFrame, users: DataFrame) -> DataFrame:
    """Fired alerts with snapshots of recipient, sensor and trigger.

    The trigger is NULL for motion.
    """
    rule = rules.select(
        F.col("id").alias("rule_id"), "owner_id", "rule_type", "comparison_operator", "threshold_value",
        "threshold_unit", "cooldown_minutes",
    )
    recipient = users.select(
        F.col("id").alias("owner_id"),
        F.struct(
            "email",
            F.col("preferred_language").alias("language"),
            F.col("preferred_temperature_unit").alias("temperature_unit"),
            zones.safe_zone("preferred_timezone").alias("timezone"),
        ).alias("recipient"),
    )
    sensor = sensors.select(
        F.col("id").alias("sensor_id"),
        F.struct("id", "type", "name", "home_location", "city", "district").alias("sensor"),
    )
    trigger = F.when(
        F.col("rule_type") == "NUMERIC_THRESHOLD",
        F.struct(
            "comparison_operator",
            F.col("numeric_value").alias("reading_value"),
            "threshold_value",
            F.col("threshold_unit").alias("unit"),
        ),
    )
    return (
        fires.join(rule, "rule_id")
        .join(recipient, "owner_id")
        .join(sensor, "sensor_id")
        .select(
            "rule_id",
            "reading_id",
            "recipient",
            "sensor",
            "recorded_at",
            "cooldown_minutes",
            trigger.alias("trigger"),
        )
    )


def alert_messages(events: DataFrame, templates: DataFrame) -> DataFrame:
    """Subject and body of each alert in the recipient's language, unit, zone and number format."""
    language, kind = F.col("recipient.language"), F.col("sensor.type")
    segment = F.concat(F.lit("email.alert."), F.lower(kind))
    pieces_of = lambda key: F.try_element_at(F.col("bundle"), key)
    text_of = lambda key: text.fill_pieces(pieces_of(key), F.lit(""))
    when = display.alert_time_text(F.col("recorded_at"), F.col("recipient.timezone"))
    minutes = display.locale_integer(F.col("cooldown_minutes"), language)
    in_celsius = F.col("trigger.unit") == "C"
    unit = F.col("recipient.temperature_unit")
    shown = lambda value: display.locale_number(
        F.when(in_celsius, units.from_celsius(value, unit)).otherwise(value), language
    )
    symbol = F.when(in_celsius, units.temperature_symbol(unit)).otherwise(
        text_of(F.lit("measurement.relativeHumidity.symbol"))
    )
    place = [F.col(f"sensor.{name}") for name in ("name", "home_location", "city", "district")]
    numeric_body = text.fill_pieces(
        pieces_of(F.concat(segment, F.lit(".body"))),
        *place,
        text_of(F.concat(F.lit("comparisonOperator."), F.col("trigger.comparison_operator"))),
        shown(F.col("trigger.reading_value")),
        shown(F.col("trigger.threshold_value")),
        symbol,
        when,
        minutes,
    )
    motion_body = text.fill_pieces(
        pieces_of(F.lit("email.alert.motion.body")),
        *place,
        text_of(F.lit("alertEventType.MOTION_DETECTED")),
        when,
        minutes,
    )
    # One row per language, whatever the number of alerts.
    by_language = F.broadcast(bundles(templates))
    return events.join(by_language, F.col("recipient.language") == F.col("lang")).select(
        "rule_id",
        "reading_id",
        F.col("recipient.email").alias("email"),
        text.fill_pieces(pieces_of(F.concat(segment, F.lit(".subject"))), F.col("sensor.name")).alias("subject"),
        F.when(F.col("trigger").isNotNull(), numeric_body).otherwise(motion_body).alias("body"),
    )
