"""Operators: functions from DataFrames (plus column names and rule lists) to DataFrames."""
