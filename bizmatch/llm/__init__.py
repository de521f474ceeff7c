"""Operators for large text corpora: search, joins, filters, mixing, tokenizing and output.

Nothing else in the package imports this subpackage.
"""
