"""The feed of form-encoded reading requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog import schema


def read_requests(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    """Batch scan of stored requests (parquet, json, orc or csv)."""
    return spark.read.format(source).schema(schema.REQUESTS).load(path)


def stream_requests(
    spark: SparkSession, path: str, source: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    """Unbounded scan of a folder that receives request files."""
    reader = spark.readStream.format(source).schema(schema.REQUESTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_kafka_requests(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Unbounded scan of a topic whose values are JSON request rows (needs the Kafka package).

    The time of arrival is the record's own timestamp.
    """
    record = T.StructType([f for f in schema.REQUESTS.fields if f.name != "received_at"])
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(
        F.from_json(F.col("value").cast("string"), record).alias("r"),
        F.col("timestamp").alias("received_at"),
    ).select("r.request_id", "received_at", "r.path", "r.body")
