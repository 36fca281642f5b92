"""Spark analytics for rare-event transaction tables."""
