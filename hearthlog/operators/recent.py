"""Latest readings, list pages and page counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions import display, numbers, units, zones
from hearthlog.schema import READINGS, RECENT_ROWS
from hearthlog.session import cut


def latest(readings: DataFrame, rows: int = RECENT_ROWS) -> DataFrame:
    """Newest ``rows`` readings of every sensor, equal times ordered by id.

    Spark limits each sensor's rows inside every task before the exchange, so a hot sensor sends a
    handful of rows per task.
    """
    newest_first = Window.partitionBy("sensor_id").orderBy(F.desc("recorded_at"), F.desc("id"))
    return readings.withColumn("position", F.row_number().over(newest_first)).where(F.col("position") <= rows)


def merge_latest(*tops: DataFrame, rows: int = RECENT_ROWS) -> DataFrame:
    """The newest ``rows`` readings of every sensor in any of ``tops``.

    The operation is associative: tops of disjoint sets of readings merge into the top of all.
    """
    merged = tops[0]
    for other in tops[1:]:
        merged = merged.unionByName(other)
    return latest(merged, rows).drop("position")


def day_counts(readings: DataFrame) -> DataFrame:
    """Readings per sensor and stored day; the scan reads the sensor column only."""
    return readings.groupBy("sensor_id", "recorded_date").agg(F.count(F.lit(1)).alias("n"))


def latest_of_days(readings: DataFrame, counts: DataFrame, rows: int = RECENT_ROWS) -> DataFrame:
    """Newest ``rows`` readings of every sensor from a table stored by day, reading needed days only.

    ``counts`` are the table's ``day_counts``. A sensor needs its newest days until they hold enough
    readings, be they yesterday's or a year old. Only day folders that some sensor needs are scanned, and
    of these only the sensors that need them go on.
    """
    newest_first = Window.partitionBy("sensor_id").orderBy(F.desc("recorded_date"))
    before = F.coalesce(F.sum("n").over(newest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = counts.withColumn("before", before).where(F.col("before") < rows).select("sensor_id", "recorded_date")
    needed = cut(needed)
    # One value per day of history.
    days = [row[0] for row in needed.select("recorded_date").distinct().collect()]
    kept = readings.where(F.col("recorded_date").isin(days)).join(needed, ["sensor_id", "recorded_date"], "left_semi")
    return merge_latest(kept.select(*READINGS.names), rows=rows)


def recent_readings(
    readings: DataFrame, sensors: DataFrame, users: DataFrame, rows: int = RECENT_ROWS
) -> DataFrame:
    """Newest readings as shown to the sensor's owner; sensors are joined after the limit."""
    owners = users.select(
        F.col("id").alias("owner_id"),
        F.col("preferred_temperature_unit").alias("preferred_unit"),
        F.col("preferred_language").alias("language"),
    )
    described = (
        sensors.where(zones.valid_zone("time_zone_id"))
        .select(
            F.col("id").alias("sensor_id"),
            "owner_id",
            F.col("type").alias("sensor_type"),
            F.col("home_location").alias("location"),
            zones.safe_zone("time_zone_id").alias("zone"),
        )
        .join(owners, "owner_id", "left")
    )
    kind, unit, zone = F.col("sensor_type"), F.col("preferred_unit"), F.col("zone")
    shown = units.display_value(kind, F.col("numeric_value"), unit)
    symbol = units.unit_symbol(kind, unit)
    return latest(readings, rows).join(described, "sensor_id").select(
        "sensor_id",
        "owner_id",
        "position",
        F.col("id").alias("reading_id"),
        "sensor_type",
        "location",
        shown.alias("numeric_value"),
        "boolean_value",
        symbol.alias("unit_symbol"),
        display.recent_value_text(kind, shown, F.col("boolean_value"), symbol, F.col("language")).alias(
            "value_text"
        ),
        display.local_time_text(F.col("recorded_at"), zone).alias("local_time"),
        zones.offset_text(F.col("recorded_at"), zone).alias("offset_text"),
    )


def sensor_list(sensors: DataFrame) -> DataFrame:
    """List pages of all owners, each newest first.

    A global sort cuts an owner with very many sensors into several ranges.
    """
    return sensors.orderBy("owner_id", F.desc("created_at"), F.desc("id")).select(
        "owner_id",
        "id",
        "name",
        "type",
        "city",
        "district",
        "home_location",
        F.col("time_zone_id").alias("timezone"),
        "active",
    )


def owner_sensor_list(sensors: DataFrame, owner_id: int) -> DataFrame:
    """List page of one owner, ordered."""
    return (
        sensors.where(F.col("owner_id") == owner_id)
        .orderBy(F.desc("created_at"), F.desc("id"))
        .select(
            "id", "name", "type", "city", "district", "home_location",
            F.col("time_zone_id").alias("timezone"), "active",
        )
    )


def rule_list(rules: DataFrame, sensors: DataFrame, users: DataFrame) -> DataFrame:
    """List page of rules with their sensor and the threshold in the owner's unit.

    Rules whose stored unit contradicts the sensor type are not listed; the quality job reports them.
    """
    owned = sensors.select(
        F.col("id").alias("sensor_id"),
        F.col("name").alias("sensor_name"),
        F.col("home_location").alias("sensor_home_location"),
        F.col("type").alias("sensor_type"),
    )
    owners = users.select(F.col("id").alias("owner_id"), F.col("preferred_temperature_unit").alias("unit"))
    numeric = F.col("rule_type") == "NUMERIC_THRESHOLD"
    consistent = ~numeric | F.coalesce(
        F.col("threshold_unit") == numbers.canonical_unit(F.col("sensor_type")), F.lit(False)
    )
    threshold = F.when(
        numeric, units.display_value(F.col("sensor_type"), F.col("threshold_value"), F.col("unit"))
    )
    return (
        rules.join(owned, "sensor_id")
        .join(owners, "owner_id")
        .where(consistent)
        .select(
            "owner_id",
            "id",
            "sensor_id",
            "sensor_name",
            "sensor_home_location",
            "sensor_type",
            "rule_type",
            "comparison_operator",
            "event_type",
            threshold.alias("threshold_value"),
            "cooldown_minutes",
            "enabled",
            "created_at",
        )
        .orderBy("owner_id", F.desc("created_at"), F.desc("id"))
    )


def owner_counts(sensors: DataFrame, readings: DataFrame, rules: DataFrame, rows: int = RECENT_ROWS) -> DataFrame:
    """Per owner: number of sensors, of readings shown on recent pages, and of rules."""
    per_sensor = readings.groupBy("sensor_id").agg(
        F.least(F.count(F.lit(1)), F.lit(rows)).alias("shown")
    )
    of_sensors = (
        sensors.select("owner_id", F.col("id").alias("sensor_id"))
        .join(per_sensor, "sensor_id", "left")
        .groupBy("owner_id")
        .agg(
            F.count(F.lit(1)).alias("n_sensors"),
            F.coalesce(F.sum("shown"), F.lit(0)).alias("n_recent_readings"),
        )
    )
    of_rules = rules.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_rules"))
    return of_sensors.join(of_rules, "owner_id", "full").select(
        "owner_id",
        F.coalesce("n_sensors", F.lit(0)).alias("n_sensors"),
        F.coalesce("n_recent_readings", F.lit(0)).alias("n_recent_readings"),
        F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
    )
