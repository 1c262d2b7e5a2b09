"""sensorweave: PySpark-native analytics for multi-rate sensor telemetry."""
