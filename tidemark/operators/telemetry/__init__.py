"""Operators over collected telemetry tables."""
