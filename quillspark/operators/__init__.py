"""Relational operators: index, search, metadata, control, export, analytics."""
