"""Tracewright: ordered event traces on Spark."""
