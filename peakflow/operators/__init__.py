"""Relational operators over peaks and targets."""
