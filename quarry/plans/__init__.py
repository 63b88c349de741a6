"""Registered queries: one per SURVEY §2 row, with its DuckDB oracle."""
