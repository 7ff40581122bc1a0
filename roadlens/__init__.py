"""Mobility and road-safety analytics expressed as lazy Spark plans."""
