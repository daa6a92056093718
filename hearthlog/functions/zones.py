"""Time-zone expressions over a zone column."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset-style ids: Z, +h, +hh, +hh:mm, +hhmm, +hh:mm:ss, +hhmmss, alone or after UTC, GMT, UT.
_HOURS = r"(?:0[0-9]|1[0-7])"
_SIXTY = r"[0-5][0-9]"
_OFFSET = (
    rf"[+-](?:[0-9]|{_HOURS}|{_HOURS}:{_SIXTY}|{_HOURS}{_SIXTY}"
    rf"|{_HOURS}:{_SIXTY}:{_SIXTY}|{_HOURS}{_SIXTY}{_SIXTY}|18(?::?00(?::?00)?)?)"
)
_OFFSET_ID = rf"^(?:Z|(?:UTC|GMT|UT)?{_OFFSET}|UTC|GMT|UT)$"
# An offset id whose minutes are no multiple of 15, or that carries seconds.
_OFF_GRID_ID = (
    rf"[+-]{_HOURS}:?(?!(?:00|15|30|45))({_SIXTY})|[+-]{_HOURS}:?{_SIXTY}:?(?!00)({_SIXTY})$"
)

SLOT_SECONDS = 900
# From this instant on all regions keep offsets that are multiples of a slot (the last to change, in
# October 1979, was Pacific/Kiritimati, until then at -10:40).
ON_GRID_SINCE = "1980-01-01 00:00:00"


@lru_cache(maxsize=1)
def region_ids() -> tuple[str, ...]:
    """Region ids of the JVM's time-zone database, which is the one that evaluates zone expressions."""
    return tuple(sorted(SparkContext._active_spark_context._jvm.java.time.ZoneId.getAvailableZoneIds()))


@lru_cache(maxsize=1)
def _region_list() -> str:
    return ", ".join(f"'{zone}'" for zone in region_ids())


def valid_zone(column: str) -> Column:
    """TRUE where the named column holds a usable zone id; FALSE for NULL and unknown ids."""
    region = F.expr(f"`{column}` IN ({_region_list()})")
    return F.coalesce(region | F.col(column).rlike(_OFFSET_ID), F.lit(False))


def safe_zone(column: str) -> Column:
    """The zone in the named column, or UTC where it is unusable: an unknown id would fail the job.

    Apply it once per row of the table that holds the zones (sensors, users), before joining.
    """
    return F.when(valid_zone(column), F.col(column)).otherwise(F.lit("UTC"))


def on_quarter_hour(column: str) -> Column:
    """TRUE when the zone in the named column keeps offsets that are multiples of 15 minutes.

    Every region of the time-zone database does since 1980; only an offset-style id can break it.
    """
    zone = F.col(column)
    return ~(zone.rlike(_OFFSET_ID) & zone.rlike(_OFF_GRID_ID))


def local_timestamp(instant: Column, zone: Column) -> Column:
    """Wall-clock time of an instant; never ambiguous. ``zone`` must be usable."""
    return F.from_utc_timestamp(instant, zone)


def local_date(instant: Column, zone: Column) -> Column:
    return F.to_date(local_timestamp(instant, zone))


def start_of_day(day: Column, zone: Column) -> Column:
    """Instant at which a local day begins (a day lasts 23, 24 or 25 hours)."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def offset_seconds(instant: Column, zone: Column) -> Column:
    return F.unix_seconds(local_timestamp(instant, zone)) - F.unix_seconds(instant)


def _signed_offset(seconds: Column) -> Column:
    size = F.abs(seconds)
    two = lambda number: F.lpad(F.floor(number).cast("string"), 2, "0")
    rest = size % 60
    return F.concat(
        F.when(seconds < 0, F.lit("-")).otherwise(F.lit("+")),
        two(size / 3600),
        F.lit(":"),
        two((size % 3600) / 60),
        F.when(rest > 0, F.concat(F.lit(":"), two(rest))).otherwise(F.lit("")),
    )


def offset_id(instant: Column, zone: Column) -> Column:
    """Offset in force at an instant: ``+05:45``, or ``Z`` for zero."""
    seconds = offset_seconds(instant, zone)
    return F.when(seconds == 0, F.lit("Z")).otherwise(_signed_offset(seconds))


def offset_text(instant: Column, zone: Column) -> Column:
    """Offset followed by the zone, ``+03:00[Europe/Istanbul]``."""
    return F.concat(offset_id(instant, zone), F.lit("["), zone, F.lit("]"))


def zone_label(zone: Column, as_of: Column) -> Column:
    """Catalogue label of a zone, ``UTC+03:00 - Europe/Istanbul``."""
    return F.concat(F.lit("UTC"), _signed_offset(offset_seconds(as_of, zone)), F.lit(" - "), zone)


def utc_date(instant: dt.datetime) -> dt.date:
    """UTC date of an aware ``datetime``, the partition it falls in."""
    return instant.astimezone(dt.timezone.utc).date()


def slot_start(instant: Column, seconds: int = SLOT_SECONDS) -> Column:
    """Start of the UTC slot an instant falls in."""
    epoch = F.unix_seconds(instant)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))
