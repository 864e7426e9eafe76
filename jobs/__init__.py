"""Runnable jobs: python -m jobs.trace_catalogue and python -m jobs.daily_traffic, each with a small configuration file."""
