"""DataFrame-to-DataFrame jobs over the sensor tables."""
