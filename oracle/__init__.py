"""DuckDB statements of the registered queries, for checking results."""
