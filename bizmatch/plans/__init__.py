"""Whole runs: resolve, rescore, train, and their command lines."""
