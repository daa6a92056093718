"""Numeric checks and measurement rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlog.schema import (
    ABSOLUTE_ZERO_C,
    HUMIDITY_MAX,
    HUMIDITY_MIN,
    NUMERIC_SENSOR_TYPES,
)

# Thermistor calibration.
_SERIES_OHMS = 11000.0
_ADC_STEPS = 1024.0
_STEINHART_A = 0.001129148
_STEINHART_B = 0.000234125
_STEINHART_C = 0.0000000876741
_KELVIN_OFFSET = 273.15
_ADC_ERROR = -999.0


def is_finite(value: Column) -> Column:
    """TRUE for an ordinary number; FALSE for NULL, NaN and both infinities."""
    return (
        value.isNotNull()
        & ~F.isnan(value)
        & (value < F.lit(float("inf")))
        & (value > F.lit(float("-inf")))
    )


def int_between(value: Column, low: int, high: int) -> Column:
    """TRUE when ``value`` is present and within both inclusive bounds."""
    return F.coalesce(value.between(low, high), F.lit(False))


def supports_numeric(sensor_type: Column) -> Column:
    return sensor_type.isin(*NUMERIC_SENSOR_TYPES)


def canonical_unit(sensor_type: Column) -> Column:
    """Storage unit of a sensor type; NULL for motion."""
    return F.when(sensor_type == "TEMPERATURE", F.lit("C")).when(
        sensor_type == "HUMIDITY", F.lit("PERCENT")
    )


def valid_measurement(sensor_type: Column, value: Column) -> Column:
    """TRUE when a finite value lies in the range of its sensor type."""
    in_range = (
        F.when(sensor_type == "TEMPERATURE", value >= F.lit(ABSOLUTE_ZERO_C))
        .when(sensor_type == "HUMIDITY", value.between(F.lit(HUMIDITY_MIN), F.lit(HUMIDITY_MAX)))
        .otherwise(F.lit(False))
    )
    return is_finite(value) & F.coalesce(in_range, F.lit(False))


def adc_to_celsius(adc: Column) -> Column:
    """Temperature of a 10-bit thermistor sample; 0 gives the error value -999."""
    reading = F.nullif(adc.cast("double"), F.lit(0.0))
    ratio = F.lit(_ADC_STEPS) / reading - F.lit(1.0)
    log_ohms = F.ln(F.lit(_SERIES_OHMS) * ratio)
    kelvin = F.lit(1.0) / (
        F.lit(_STEINHART_A) + (F.lit(_STEINHART_B) + (F.lit(_STEINHART_C) * log_ohms * log_ohms)) * log_ohms
    )
    return F.when(adc == 0, F.lit(_ADC_ERROR)).otherwise(kelvin - F.lit(_KELVIN_OFFSET))
