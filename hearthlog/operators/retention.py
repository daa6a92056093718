"""Retention and cascading deletes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.functions.zones import utc_date
from hearthlog.schema import READINGS, RETENTION_DAYS
from hearthlog.session import cut
from hearthlog.sources import files
from hearthlog.sources.sinks import by_day
from hearthlog.sources.tables import read_readings


def retained(df: DataFrame, time: str, cutoff: dt.datetime, inclusive: bool = False) -> DataFrame:
    """Rows that survive a purge at ``cutoff``.

    A row exactly at the cutoff stays, unless ``inclusive`` purges it too.
    """
    bound = F.lit(cutoff).cast("timestamp")
    return df.where(F.col(time) > bound if inclusive else F.col(time) >= bound)


def retained_readings(readings: DataFrame, as_of: dt.datetime, days: int = RETENTION_DAYS) -> DataFrame:
    cutoff = as_of - dt.timedelta(days=days)
    kept = retained(readings, "recorded_at", cutoff)
    if "recorded_date" in readings.columns:
        kept = kept.where(F.col("recorded_date") >= utc_date(cutoff))
    return kept


def retained_challenges(challenges: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Challenges that have not expired; one that expires right now is gone."""
    return retained(challenges, "expires_at", as_of, inclusive=True)


def purge_readings(spark: SparkSession, table: str, as_of: dt.datetime, days: int = RETENTION_DAYS) -> None:
    """Purge a catalogue table partitioned by ``recorded_date``.

    Whole days before the cutoff are dropped as partitions without reading them; only the day the
    cutoff falls in is rewritten.
    """
    cutoff = as_of - dt.timedelta(days=days)
    boundary = utc_date(cutoff)
    # Partition names only: one entry per day of history.
    dates = [row[0].split("=", 1)[1] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    expired = sorted(day for day in dates if day < boundary.isoformat())
    _drop_days(spark, table, expired)
    if boundary.isoformat() not in dates:
        return
    day = spark.table(table).where(F.col("recorded_date") == F.lit(boundary))
    _replace_days(spark, table, [boundary.isoformat()], retained(day, "recorded_at", cutoff))


def purge_sensor_readings(spark: SparkSession, table: str, deleted: DataFrame) -> None:
    """Delete the readings of the sensors listed in ``deleted`` from a partitioned catalogue table.

    Only the days on which those sensors have readings are rewritten.
    """
    gone = deleted.select(F.col("id").alias("sensor_id"))
    touched = spark.table(table).join(gone, "sensor_id", "left_semi").select("recorded_date").distinct()
    # One row per day of history.
    days = sorted(row[0].isoformat() for row in touched.collect())
    if days:
        rows = spark.table(table).where(F.col("recorded_date").isin([dt.date.fromisoformat(day) for day in days]))
        _replace_days(spark, table, days, without_sensors(rows, deleted))


def delete_sensor_files(spark: SparkSession, path: str, deleted: DataFrame) -> int:
    """Delete the readings of the sensors in ``deleted`` (column ``id``) from the fact table at ``path``.

    Only files that hold such readings are rewritten; in the clustered layout a sensor's day lies in one
    file, so a delete costs about as much as the deleted sensors' own files. Returns their number.
    """
    files.recover(spark, path)
    gone = deleted.select(F.col("id").alias("sensor_id"))
    places = read_readings(spark, path).select("sensor_id", F.col("_metadata.file_path").alias("file"))
    hit = places.join(gone, "sensor_id", "left_semi").select("file").distinct()
    return _rewrite_files(spark, path, hit, lambda rows: without_sensors(rows, deleted))


def purge_files(spark: SparkSession, path: str, as_of: dt.datetime, days: int = RETENTION_DAYS) -> int:
    """Purge the fact table at ``path``; returns the number of files rewritten.

    Files of days before the cutoff are removed unread. On the cutoff's own day, only files that hold
    readings before it are rewritten; their bounds let the scan skip most others.
    """
    files.recover(spark, path)
    cutoff = as_of - dt.timedelta(days=days)
    boundary = f"recorded_date={utc_date(cutoff).isoformat()}"
    names = [name for name in files.children(spark, path) if name.startswith("recorded_date=")]
    expired = files.files_of(spark, path, [name for name in names if name < boundary])
    if expired:
        files.exchange(spark, path, None, expired)
    if boundary not in names:
        return 0
    day = read_readings(spark, path).where(F.col("recorded_date") == F.lit(utc_date(cutoff)))
    old = day.where(F.col("recorded_at") < F.lit(cutoff).cast("timestamp"))
    hit = old.select(F.col("_metadata.file_path").alias("file")).distinct()
    return _rewrite_files(spark, path, hit, lambda rows: retained(rows, "recorded_at", cutoff))


def _rewrite_files(spark: SparkSession, path: str, hit: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> int:
    """Exchange the files named in ``hit`` for files of those of their rows that ``keep`` keeps."""
    # Names of files only, as in the table's own listing.
    names = sorted("/".join(row[0].split("/")[-2:]) for row in hit.collect())
    if names:
        rows = spark.read.schema(READINGS).option("basePath", path).parquet(*[f"{path}/{name}" for name in names])
        files.exchange(spark, path, by_day(keep(rows.select(*READINGS.names)).select(*READINGS.names)), names)
    return len(names)


def _drop_days(spark: SparkSession, table: str, days: list[str]) -> None:
    if days:
        specs = ", ".join(f"PARTITION (recorded_date = DATE'{day}')" for day in days)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


def _replace_days(spark: SparkSession, table: str, days: list[str], rows: DataFrame) -> None:
    """Make ``rows`` the whole content of the given days.

    The rows come from the table itself, so they are staged before their partitions are replaced.
    """
    staged = cut(rows)
    _overwrite_partitions(spark, staged, table)
    left = {row[0].isoformat() for row in staged.select("recorded_date").distinct().collect()}
    _drop_days(spark, table, [day for day in days if day not in left])


def _overwrite_partitions(spark: SparkSession, df: DataFrame, table: str) -> None:
    """Replace exactly the partitions that occur in ``df``."""
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        df.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)


def without(df: DataFrame, deleted: DataFrame, reference: str) -> DataFrame:
    """Rows whose ``reference`` is none of the rows listed in ``deleted`` (column ``id``)."""
    return df.join(deleted.select(F.col("id").alias(reference)), reference, "left_anti")


def without_sensors(df: DataFrame, deleted: DataFrame, sensor_column: str = "sensor_id") -> DataFrame:
    """Rows that survive the deletion of the sensors listed in ``deleted`` (column ``id``)."""
    return without(df, deleted, sensor_column)


def delete_sensors(
    sensors: DataFrame, readings: DataFrame, rules: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sensors, readings and rules after a cascading delete."""
    return (
        without_sensors(sensors, deleted, "id"),
        without_sensors(readings, deleted),
        without_sensors(rules, deleted),
    )


def delete_users(stored: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables of the data model, by name, after the users in ``deleted`` (column ``id``) are gone.

    With a user go the sensors, their readings and rules, the user's own rules, and both kinds of
    challenges.
    """
    gone = stored["sensors"].join(deleted.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    sensors, readings, rules = delete_sensors(
        stored["sensors"], stored["sensor_readings"], stored["alert_rules"], gone
    )
    challenges = ("email_verification_challenges", "password_reset_challenges")
    return {
        "app_users": without(stored["app_users"], deleted, "id"),
        "sensors": sensors,
        "sensor_readings": readings,
        "alert_rules": without(rules, deleted, "owner_id"),
        **{name: without(stored[name], deleted, "user_id") for name in challenges},
    }
