"""Spatio-temporal footprint analytics as Spark jobs."""
