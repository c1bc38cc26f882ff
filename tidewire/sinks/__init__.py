"""DataFrames to capture files, CSV, JSON, XML and text."""
