"""Telemetry and document analytics as composable PySpark DataFrame transforms."""
