"""Registered queries and their DuckDB statements, one module per area."""
