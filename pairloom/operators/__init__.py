"""Relational operators: joins, gates, aggregates, windows, graphs, statistics."""
