"""Operators on half-hourly flux tables."""
