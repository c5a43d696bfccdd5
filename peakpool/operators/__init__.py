"""Operators over site tables."""
