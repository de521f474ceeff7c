"""Column functions: text forms, blocking keys, similarities."""
