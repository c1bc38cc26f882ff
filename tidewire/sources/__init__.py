"""Capture files, generated traffic, target lists and system tables as DataFrames."""
