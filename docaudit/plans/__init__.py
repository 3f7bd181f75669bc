"""Composed jobs and the query catalogue."""
