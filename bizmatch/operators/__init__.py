"""Relational operators of matching: candidates, scores, selection, evaluation, training."""
