"""Observations as they arrive."""
