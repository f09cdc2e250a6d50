"""DuckDB counterparts of the catalog queries."""
