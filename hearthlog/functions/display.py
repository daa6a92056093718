"""Text forms of values, dates and hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlog.functions.zones import local_timestamp, offset_id

# Labels and day names, Sunday first.
NO_DATA = {"ENGLISH": "No data recorded", "TURKISH": "Kayıtlı veri yok"}
AVERAGE = {"ENGLISH": "Average", "TURKISH": "Ortalama"}
DETECTIONS = {"ENGLISH": "Detections", "TURKISH": "Algılama sayısı"}
MOTION_DETECTED = {"ENGLISH": "Detected", "TURKISH": "Algılandı"}
MOTION_CLEAR = {"ENGLISH": "No motion", "TURKISH": "Hareket yok"}
DAY_NAMES = {
    "ENGLISH": ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"),
    "TURKISH": ("Pazar", "Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi"),
}


def by_language(language: Column, texts: dict[str, str]) -> Column:
    """The text in the reader's language; English unless Turkish."""
    return F.when(language == "TURKISH", F.lit(texts["TURKISH"])).otherwise(F.lit(texts["ENGLISH"]))


def _pattern(value: Column, pattern: str) -> Column:
    """Number in a decimal pattern; the Python wrapper of this function takes a digit count only."""
    return F.call_function("format_number", value, F.lit(pattern))


def two_decimals(value: Column) -> Column:
    """Two decimals, exact ties half-even."""
    return _pattern(value, "0.00")


def fixed_two(value: Column) -> Column:
    """Two decimals, exact ties away from zero.

    A double sits exactly on a tie only when it is an odd multiple of 1/8; of those the half-even
    result differs for .125 and .625, which are nudged off the tie.
    """
    tie = (F.abs(value) * F.lit(8.0)) % F.lit(4.0) == F.lit(1.0)
    return two_decimals(F.when(tie, value + F.signum(value) * F.lit(0.001)).otherwise(value))


def whole(value: Column) -> Column:
    """Nearest whole number as text, halves up."""
    return F.floor(value + F.lit(0.5)).cast("string")


def format_metric(sensor_type: Column, value: Column, language: Column) -> Column:
    """Value of a statistics cell."""
    return (
        F.when(value.isNull(), by_language(language, NO_DATA))
        .when(sensor_type == "MOTION", whole(value))
        .otherwise(fixed_two(value))
    )


def labelled_metric(sensor_type: Column, value: Column, symbol: Column, language: Column) -> Column:
    """Value with its label and unit, ``Average: 21.50 °C`` or ``Detections: 3``."""
    unit = F.when(symbol == "", F.lit("")).otherwise(F.concat(F.lit(" "), symbol))
    return (
        F.when(value.isNull(), by_language(language, NO_DATA))
        .when(sensor_type == "MOTION", F.concat(by_language(language, DETECTIONS), F.lit(": "), whole(value)))
        .otherwise(F.concat(by_language(language, AVERAGE), F.lit(": "), fixed_two(value), unit))
    )


def hour_range(hour: Column) -> Column:
    """``HH:00–HH:00``; hour 23 ends at 00."""
    two = lambda number: F.lpad(number.cast("int").cast("string"), 2, "0")
    return F.concat(two(hour), F.lit(":00–"), two((hour + 1) % 24), F.lit(":00"))


def display_date(day: Column, language: Column) -> Column:
    """``DayName, dd-MM-yyyy``."""
    index = F.dayofweek(day)
    names = {lang: F.array(*[F.lit(name) for name in DAY_NAMES[lang]]) for lang in DAY_NAMES}
    name = F.when(language == "TURKISH", F.element_at(names["TURKISH"], index)).otherwise(
        F.element_at(names["ENGLISH"], index)
    )
    return F.concat(name, F.lit(", "), F.date_format(day, "dd-MM-yyyy"))


def local_time_text(instant: Column, zone: Column) -> Column:
    return F.date_format(local_timestamp(instant, zone), "dd-MM-yyyy HH:mm:ss")


def alert_time_text(instant: Column, zone: Column) -> Column:
    """Local time followed by the offset in force."""
    return F.concat(local_time_text(instant, zone), F.lit(" "), offset_id(instant, zone))


def _localized(text: Column, language: Column) -> Column:
    return F.when(language == "TURKISH", F.translate(text, ",.", ".,")).otherwise(text)


def recent_value_text(
    sensor_type: Column, value: Column, flag: Column, symbol: Column, language: Column
) -> Column:
    """Value of a recent reading: number and unit, or the motion state."""
    number = F.concat(_localized(two_decimals(value), language), F.lit(" "), symbol)
    motion = F.when(flag, by_language(language, MOTION_DETECTED)).otherwise(by_language(language, MOTION_CLEAR))
    return F.when(sensor_type == "MOTION", motion).otherwise(number)


def locale_number(value: Column, language: Column) -> Column:
    """One or two decimals with grouping, in the separators of the language."""
    return _localized(_pattern(value, "#,##0.0#"), language)


def locale_integer(value: Column, language: Column) -> Column:
    """Whole number with grouping, in the separators of the language."""
    return _localized(_pattern(value, "#,##0"), language)
