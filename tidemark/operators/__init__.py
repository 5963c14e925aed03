"""Relational operators: as-of joins, windows, aggregates, sets, ladders."""
