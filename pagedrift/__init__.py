"""Spark-first analytics for observing how web documents change over time."""
