"""Sequence-window analytics as Spark jobs."""
