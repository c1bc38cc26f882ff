"""Packet predicates as Spark columns."""
