"""Sources and sinks: flat CSV input, the test-table stand-in, Parquet tables."""

from starlane.sources.flat import FLAT_SCHEMA, read_flat_csv, standin_flat, write_flat_csv
from starlane.sources.tables import read_tables, write_tables

__all__ = ["FLAT_SCHEMA", "read_flat_csv", "standin_flat", "write_flat_csv", "read_tables", "write_tables"]
