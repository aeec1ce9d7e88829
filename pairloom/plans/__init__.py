"""Composed queries and their DuckDB oracles."""
