"""Temperature conversion and display units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _resolved(unit: Column) -> Column:
    return F.coalesce(unit, F.lit("CELSIUS"))


def from_celsius(value: Column, unit: Column) -> Column:
    """Celsius to the wanted unit; a NULL unit means Celsius."""
    target = _resolved(unit)
    return (
        F.when(target == "FAHRENHEIT", (value * F.lit(9.0) / F.lit(5.0)) + F.lit(32.0))
        .when(target == "KELVIN", value + F.lit(273.15))
        .otherwise(value)
    )


def to_celsius(value: Column, unit: Column) -> Column:
    """A value in ``unit`` to Celsius; a NULL unit means Celsius."""
    source = _resolved(unit)
    return (
        F.when(source == "FAHRENHEIT", (value - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0))
        .when(source == "KELVIN", value - F.lit(273.15))
        .otherwise(value)
    )


def temperature_symbol(unit: Column) -> Column:
    target = _resolved(unit)
    return (
        F.when(target == "FAHRENHEIT", F.lit("°F")).when(target == "KELVIN", F.lit("K")).otherwise(F.lit("°C"))
    )


def unit_symbol(sensor_type: Column, unit: Column) -> Column:
    """Symbol shown next to a value of this sensor type."""
    return (
        F.when(sensor_type == "TEMPERATURE", temperature_symbol(unit))
        .when(sensor_type == "HUMIDITY", F.lit("% RH"))
        .otherwise(F.lit(""))
    )


def display_value(sensor_type: Column, value: Column, unit: Column) -> Column:
    """Stored value in the reader's unit. Averages are taken before this conversion."""
    return F.when(sensor_type == "TEMPERATURE", from_celsius(value, unit)).otherwise(value)
