"""Reconciliation, change-data-capture and fleet-telemetry analytics on Spark."""
