"""Registered queries of the library's own operators, each with its DuckDB oracle."""
