"""Peaks as they arrive."""
