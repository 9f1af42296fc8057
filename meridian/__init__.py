"""Satellite-navigation, AIS and clock telemetry analytics on Spark."""
