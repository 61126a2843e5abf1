"""telespark: device-telemetry analytics as PySpark DataFrame and Structured Streaming jobs."""
