"""Pipelines and the query catalogue."""
