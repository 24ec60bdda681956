"""Profiling and association analysis of tabular data on Spark."""
