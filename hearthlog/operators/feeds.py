"""Bulk cleaning of raw device and text feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.functions import numbers, text


def calibrated(samples: DataFrame, adc: str = "adc") -> DataFrame:
    """Temperature of raw thermistor samples and whether ingestion would take it."""
    celsius = numbers.adc_to_celsius(F.col(adc))
    return samples.withColumn("celsius", celsius).withColumn(
        "valid", numbers.valid_measurement(F.lit("TEMPERATURE"), F.col("celsius"))
    )


def lenient_values(feed: DataFrame, motion: str = "motion_text", number: str = "number_text") -> DataFrame:
    """Hand-written motion words and numbers; NULL where they cannot be read."""
    return feed.withColumn("motion", text.lenient_boolean(F.col(motion))).withColumn(
        "number", text.lenient_double(F.col(number))
    )
