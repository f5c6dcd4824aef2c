"""Vantarow: telemetry incident analytics expressed as Spark plans."""
