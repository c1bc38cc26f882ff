"""Frames (BINARY) to header columns."""
