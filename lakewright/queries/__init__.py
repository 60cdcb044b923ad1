"""Registered queries: each applies core operators to the shared tables, beside its DuckDB twin."""
