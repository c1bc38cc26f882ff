"""Packet and flow analytics on Spark."""
