"""Registered report queries over the given tables and their DuckDB oracles."""
