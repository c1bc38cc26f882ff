"""Aggregates, flows, rings, scans and store reports: functions from DataFrames to DataFrames."""
