"""Whole runs, and the queries by name."""
