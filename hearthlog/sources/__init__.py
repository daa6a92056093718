"""Readers and writers of the sensor tables."""
