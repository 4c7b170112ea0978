"""Correctness checks: DuckDB twins of the registered queries."""
