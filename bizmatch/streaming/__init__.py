"""Matching of first-source records as they arrive."""
