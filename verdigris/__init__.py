"""Verdigris: evidence analytics as Spark jobs."""
