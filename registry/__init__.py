"""Queries over the driver's tables, and the SQL that DuckDB answers them with."""
