"""Fill-level telemetry and recycling-service records as Spark DataFrame operators."""
