"""Agronomic document and telemetry analytics as Spark plans."""
