"""Sensor telemetry analytics as Spark jobs: ingestion, statistics, alerts, table health."""
