"""Daily and hourly statistics in every sensor's own time zone.

Readings are first reduced to 15-minute UTC slots per sensor. That needs no sensor table, combines
on the map side (a hot sensor arrives as at most 96 rows a day per task) and, because zone offsets
are multiples of 15 minutes, local days and hours are exact unions of slots. Only the slots meet the
sensor table, so whichever join Spark picks there moves a bounded number of rows per sensor.

Ids such as ``+01:07`` are off that grid, and so were some regions before 1980. Those readings get
one-second slots, which are exact for every offset.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.functions import numbers, units, zones


def _us(instant: dt.datetime) -> Column:
    """Literal instant; ``instant`` must be time-zone aware."""
    return F.lit(instant).cast("timestamp")


def rollup_15m(readings: DataFrame, off_grid: DataFrame | None = None) -> DataFrame:
    """Mergeable partials per sensor, unit and UTC slot: sum, count and detections.

    ``off_grid`` lists the ids of sensors whose zone needs one-second slots.
    """
    rows = readings.where(F.col("numeric_value").isNotNull() | F.col("boolean_value")).select(
        "sensor_id", "numeric_value", "boolean_value", "unit", "recorded_at"
    )
    fine = F.col("recorded_at") < F.lit(zones.ON_GRID_SINCE).cast("timestamp")
    if off_grid is not None:
        rows = rows.join(off_grid.withColumn("off_grid", F.lit(True)), "sensor_id", "left")
        fine = fine | F.coalesce("off_grid", F.lit(False))
    slot = F.when(fine, F.date_trunc("second", "recorded_at")).otherwise(
        zones.slot_start(F.col("recorded_at"))
    )
    return rows.groupBy("sensor_id", "unit", slot.alias("slot_start")).agg(
        F.sum("numeric_value").alias("sum_value"),
        F.count("numeric_value").alias("n_values"),
        F.count_if("boolean_value").alias("n_detections"),
    )


def merge_rollups(*rollups: DataFrame) -> DataFrame:
    """Combine partials of disjoint sets of readings."""
    merged = rollups[0]
    for other in rollups[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("sensor_id", "unit", "slot_start").agg(*_partials())


def slots_around(rollup: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Slots of a stored rollup that can matter for the last ``days`` local days of any sensor.

    The bounds are literals on the slot itself, so they reach the scan of the stored table.
    """
    first, last = _days_around(as_of, days)
    return rollup.where((F.col("slot_start") >= _us(first)) & (F.col("slot_start") < _us(last)))


def off_grid_sensors(sensors: DataFrame) -> DataFrame | None:
    """Ids of sensors that need fine slots, or None when there are none.

    Finding out runs a job over the sensor table while the plan is built. Spark chooses the join.
    """
    ids = sensors.where(~zones.on_quarter_hour("time_zone_id")).select(F.col("id").alias("sensor_id"))
    return None if ids.isEmpty() else ids


def zoned(sensors: DataFrame) -> DataFrame:
    """The sensor columns statistics need; sensors with an unusable zone are left out."""
    return sensors.where(zones.valid_zone("time_zone_id")).select(
        F.col("id").alias("sensor_id"),
        F.col("owner_id"),
        F.col("type").alias("sensor_type"),
        zones.safe_zone("time_zone_id").alias("zone"),
    )


def unusable_zones(sensors: DataFrame) -> DataFrame:
    """Quarantine: sensors whose zone id cannot be used."""
    return sensors.where(~zones.valid_zone("time_zone_id")).select(
        F.col("id").alias("sensor_id"), "time_zone_id"
    )


def _window(readings: DataFrame, first: dt.datetime, last: dt.datetime) -> DataFrame:
    """Literal bound around the exact, zone-dependent one, so that the scan can prune."""
    kept = readings.where((F.col("recorded_at") >= _us(first)) & (F.col("recorded_at") < _us(last)))
    if "recorded_date" in readings.columns:
        kept = kept.where(F.col("recorded_date").between(zones.utc_date(first), zones.utc_date(last)))
    return kept


def _localized(rollup: DataFrame, sensors: DataFrame) -> DataFrame:
    """Slots with their sensor, local date and hour; only the canonical unit counts."""
    usable = (F.col("sensor_type") == "MOTION") | (
        F.col("unit") == numbers.canonical_unit(F.col("sensor_type"))
    )
    local = zones.local_timestamp(F.col("slot_start"), F.col("zone"))
    return (
        rollup.join(zoned(sensors), "sensor_id")
        .where(usable)
        .withColumn("local_date", F.to_date(local))
        .withColumn("local_hour", F.hour(local))
    )


def _partials() -> list[Column]:
    return [F.sum(name).alias(name) for name in ("sum_value", "n_values", "n_detections")]


def _bucket_value() -> Column:
    """Detections of a motion sensor (0 when there are none), else the average (NULL when none)."""
    detections = F.coalesce("n_detections", F.lit(0)).cast("double")
    average = F.col("sum_value") / F.nullif(F.col("n_values"), F.lit(0))
    return F.when(F.col("sensor_type") == "MOTION", detections).otherwise(average)


def daily_from_rollup(rollup: DataFrame, sensors: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Exactly ``days`` rows per sensor, oldest first by date: local today and the days before."""
    today = zones.local_date(_us(as_of), F.col("zone"))
    found = (
        _localized(rollup, sensors)
        .where(F.col("local_date").between(F.date_sub(today, days - 1), today))
        .groupBy("sensor_id", "local_date")
        .agg(*_partials())
    )
    return _daily_series(found, sensors, today, days)


def _daily_series(found: DataFrame, sensors: DataFrame, today: Column, days: int) -> DataFrame:
    spine = zoned(sensors).withColumn("today", today).select(
        "sensor_id",
        "sensor_type",
        F.explode(F.sequence(F.date_sub("today", days - 1), F.col("today"))).alias("local_date"),
    )
    return spine.join(found, ["sensor_id", "local_date"], "left").select(
        "sensor_id", "sensor_type", "local_date", _bucket_value().alias("value")
    )


def hourly_from_rollup(
    rollup: DataFrame, sensors: DataFrame, as_of: dt.datetime, date: dt.date | None = None
) -> DataFrame:
    """Exactly 24 rows per sensor for one local date (default: the sensor's own today).

    A wall-clock hour that occurs twice is one bucket; an hour that is skipped is a gap.
    """
    day = F.lit(date) if date else zones.local_date(_us(as_of), F.col("zone"))
    found = (
        _localized(rollup, sensors)
        .where(F.col("local_date") == day)
        .groupBy("sensor_id", "local_hour")
        .agg(*_partials())
    )
    return _hourly_series(found, sensors, day)


def _hourly_series(found: DataFrame, sensors: DataFrame, day: Column) -> DataFrame:
    spine = zoned(sensors).select(
        "sensor_id",
        "sensor_type",
        day.alias("local_date"),
        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("local_hour"),
    )
    return spine.join(found, ["sensor_id", "local_hour"], "left").select(
        "sensor_id", "sensor_type", "local_date", F.col("local_hour").cast("smallint").alias("hour"),
        _bucket_value().alias("value"),
    )


def hour_cells(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Mergeable partials per sensor, local date and hour of the day."""
    localized = _localized(rollup_15m(readings, off_grid_sensors(sensors)), sensors)
    return localized.groupBy("sensor_id", "local_date", "local_hour").agg(*_partials())


def merge_cells(*cells: DataFrame) -> DataFrame:
    """Combine the cells of disjoint sets of readings."""
    merged = cells[0]
    for other in cells[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("sensor_id", "local_date", "local_hour").agg(*_partials())


def daily_from_cells(cells: DataFrame, sensors: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """``daily_from_rollup`` from stored cells."""
    # Literal bounds around the dates of every zone, for the scan.
    first, last = (zones.utc_date(instant) for instant in _days_around(as_of, days))
    found = cells.where(F.col("local_date").between(F.lit(first), F.lit(last)))
    found = found.groupBy("sensor_id", "local_date").agg(*_partials())
    return _daily_series(found, sensors, zones.local_date(_us(as_of), F.col("zone")), days)


def hourly_from_cells(
    cells: DataFrame, sensors: DataFrame, as_of: dt.datetime, date: dt.date | None = None
) -> DataFrame:
    """``hourly_from_rollup`` from stored cells."""
    day = F.lit(date) if date else zones.local_date(_us(as_of), F.col("zone"))
    first, last = (date, date) if date else (zones.utc_date(instant) for instant in _days_around(as_of, 1))
    near = cells.where(F.col("local_date").between(F.lit(first), F.lit(last)))
    own = near.join(zoned(sensors).select("sensor_id", day.alias("day")), "sensor_id").where("local_date = day")
    return _hourly_series(own.drop("local_date", "day"), sensors, day)


def _days_around(as_of: dt.datetime, days: int) -> tuple[dt.datetime, dt.datetime]:
    """Instants that enclose the last ``days`` local days in every zone."""
    return as_of - dt.timedelta(days=days + 1), as_of + dt.timedelta(days=2)


def daily_statistics(readings: DataFrame, sensors: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Seven-day series of every sensor."""
    bounded = _window(readings, *_days_around(as_of, days))
    return daily_from_rollup(rollup_15m(bounded, off_grid_sensors(sensors)), sensors, as_of, days)


def hourly_statistics(
    readings: DataFrame, sensors: DataFrame, as_of: dt.datetime, date: dt.date | None = None
) -> DataFrame:
    """Hour-of-day series of every sensor for one local date."""
    centre = as_of if date is None else dt.datetime(date.year, date.month, date.day, 12, tzinfo=dt.timezone.utc)
    bounded = _window(readings, *_days_around(centre, 1))
    return hourly_from_rollup(rollup_15m(bounded, off_grid_sensors(sensors)), sensors, as_of, date)


def in_owner_unit(series: DataFrame, sensors: DataFrame, users: DataFrame) -> DataFrame:
    """A daily or hourly series with its averages converted to the unit each owner prefers."""
    owners = users.select(F.col("id").alias("owner_id"), F.col("preferred_temperature_unit").alias("unit"))
    unit_of = (
        sensors.select(F.col("id").alias("sensor_id"), "owner_id")
        .join(owners, "owner_id", "left")
        .select("sensor_id", "unit")
    )
    shown = units.display_value(F.col("sensor_type"), F.col("value"), F.col("unit"))
    return series.join(unit_of, "sensor_id").withColumn("value", shown).select(*series.columns)


def allowed_dates(dates: DataFrame, sensors: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Keep ``(sensor_id, date)`` rows up to the sensor's own today."""
    today = zones.local_date(_us(as_of), F.col("zone"))
    return (
        dates.join(zoned(sensors), "sensor_id")
        .where(F.col("date") <= today)
        .select(*dates.columns)
    )


def nested_statistics(
    readings: DataFrame, sensors: DataFrame, users: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """One row per sensor: unit symbol, today, weekly[7] and hourly[24] in the owner's unit.

    Both series come from one rollup, summed to one row per bucket (at most 7 days and 24 hours of a
    sensor) before they are collected; every point of the arrays is then one lookup.
    """
    rollup = rollup_15m(_window(readings, *_days_around(as_of, 7)), off_grid_sensors(sensors))
    today = zones.local_date(_us(as_of), F.col("zone"))
    bucket = lambda series, key: F.struct(F.lit(series).alias("series"), F.col(key).alias("key"))
    buckets = (
        _localized(rollup, sensors)
        .withColumn("days_ago", F.date_diff(today, F.col("local_date")))
        .where(F.col("days_ago").between(0, 6))
        .groupBy("sensor_id", "days_ago", "local_hour")
        .agg(*_partials())
        .withColumn(
            "bucket",
            F.explode(
                F.array(bucket("day", "days_ago"), F.when(F.col("days_ago") == 0, bucket("hour", "local_hour")))
            ),
        )
        .where(F.col("bucket").isNotNull())
        .groupBy("sensor_id", "bucket")
        .agg(*_partials())
    )
    point = F.struct(
        (F.col("sum_value") / F.nullif(F.col("n_values"), F.lit(0))).alias("average"),
        F.col("n_detections").alias("detections"),
    )
    entry = F.struct(F.col("bucket.key").alias("key"), point.alias("point"))
    by_key = lambda series: F.map_from_entries(F.collect_list(F.when(F.col("bucket.series") == series, entry)))
    found = buckets.groupBy("sensor_id").agg(by_key("day").alias("days"), by_key("hour").alias("hours"))
    owners = users.select(F.col("id").alias("owner_id"), F.col("preferred_temperature_unit").alias("unit"))
    described = (
        zoned(sensors)
        .withColumn("today", today)
        .join(owners, "owner_id", "left")
        .join(found, "sensor_id", "left")
    )
    kind = F.col("sensor_type")

    def value(points: str, key: Column) -> Column:
        at = F.try_element_at(F.col(points), key)
        shown = units.display_value(kind, at["average"], F.col("unit"))
        return F.when(kind == "MOTION", F.coalesce(at["detections"], F.lit(0)).cast("double")).otherwise(shown)

    weekly = F.transform(
        F.sequence(F.lit(6), F.lit(0), F.lit(-1)),
        lambda ago: F.struct(F.date_sub(F.col("today"), ago).alias("date"), value("days", ago).alias("value")),
    )
    hourly = F.transform(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: F.struct(h.cast("smallint").alias("hour"), value("hours", h).alias("value")),
    )
    return described.select(
        "sensor_id",
        "sensor_type",
        units.unit_symbol(kind, F.col("unit")).alias("unit_symbol"),
        "today",
        weekly.alias("weekly"),
        hourly.alias("hourly"),
    )


def series_shape_ok(weekly: Column, hourly: Column) -> Column:
    """Seven dated points, hours 0 to 23 in order, every value NULL or finite."""
    finite = lambda point: point["value"].isNull() | numbers.is_finite(point["value"])
    return (
        (F.size(weekly) == 7)
        & F.forall(weekly, lambda p: p["date"].isNotNull() & finite(p))
        & (F.transform(hourly, lambda p: p["hour"].cast("int")) == F.sequence(F.lit(0), F.lit(23)))
        & F.forall(hourly, finite)
    )


def has_data(sensor_type: Column, series: Column) -> Column:
    """Motion is always worth showing; numbers only when some value is present."""
    return (F.size(series) > 0) & (
        (sensor_type == "MOTION") | F.exists(series, lambda p: p["value"].isNotNull())
    )
