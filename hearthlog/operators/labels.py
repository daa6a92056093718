"""Statistics tables as text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.functions import display, units, zones
from hearthlog.operators.stats import has_data


def statistics_table(
    nested: DataFrame, language: str = "ENGLISH", languages: DataFrame | None = None
) -> DataFrame:
    """Rows (label, value) of the weekly and hourly tables of every sensor that has data to show.

    ``languages`` (sensor_id, language) gives each sensor the language of its reader; sensors without one,
    or all without the table, are shown in ``language``. Both arrays are exploded in one step, so the
    text is made without another exchange.
    """
    if languages is not None:
        nested = nested.join(languages.select("sensor_id", "language"), "sensor_id", "left")
        lang = F.coalesce("language", F.lit(language))
    else:
        lang = F.lit(language)
    kind = F.col("sensor_type")

    def points(series: str) -> Column:
        entry = lambda p: F.struct(
            F.lit(series).alias("series"),
            (p["date"] if series == "weekly" else F.lit(None).cast("date")).alias("date"),
            (p["hour"] if series == "hourly" else F.lit(None).cast("smallint")).alias("hour"),
            p["value"].alias("value"),
        )
        return F.when(has_data(kind, F.col(series)), F.transform(series, entry)).otherwise(F.array())

    exploded = nested.select(
        "sensor_id",
        "sensor_type",
        "unit_symbol",
        lang.alias("lang"),
        F.explode(F.concat(points("weekly"), points("hourly"))).alias("point"),
    )
    at, lang = F.col("point"), F.col("lang")
    weekly = at["series"] == "weekly"
    hour = F.lpad(at["hour"].cast("string"), 2, "0")
    return exploded.select(
        "sensor_id",
        at["series"].alias("series"),
        F.when(weekly, F.date_format(at["date"], "yyyy-MM-dd")).otherwise(hour).alias("position"),
        F.when(weekly, display.display_date(at["date"], lang)).otherwise(display.hour_range(at["hour"])).alias("label"),
        display.format_metric(kind, at["value"], lang).alias("value_text"),
        display.labelled_metric(kind, at["value"], F.col("unit_symbol"), lang).alias("tooltip"),
    )


def daily_labels(daily: DataFrame, sensors: DataFrame, users: DataFrame) -> DataFrame:
    """Seven-day series as text in each owner's unit and language."""
    owner = users.select(
        F.col("id").alias("owner_id"),
        F.col("preferred_temperature_unit").alias("unit"),
        F.col("preferred_language").alias("language"),
    )
    owned = sensors.select(F.col("id").alias("sensor_id"), "owner_id").join(owner, "owner_id", "left")
    kind, lang = F.col("sensor_type"), F.col("language")
    shown = units.display_value(kind, F.col("value"), F.col("unit"))
    return daily.join(owned, "sensor_id").select(
        "sensor_id",
        "local_date",
        display.display_date(F.col("local_date"), lang).alias("label"),
        display.format_metric(kind, shown, lang).alias("value_text"),
        display.labelled_metric(kind, shown, units.unit_symbol(kind, F.col("unit")), lang).alias("tooltip"),
    )


def zone_labels(zone_ids: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Catalogue label of every distinct usable zone in ``zone_ids`` (column ``zone``)."""
    return (
        zone_ids.select("zone")
        .distinct()
        .where(zones.valid_zone("zone"))
        .select(
            "zone",
            zones.zone_label(zones.safe_zone("zone"), F.lit(as_of).cast("timestamp")).alias("label"),
        )
    )
