"""Registered queries: Spark jobs over the given tables, each with its DuckDB twin."""
