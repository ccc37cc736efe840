"""Spark-native telemetry investigation engine."""
