"""Fleet telemetry analytics as PySpark DataFrame jobs."""
