"""The library's queries over the driver's tables, with their equivalents in DuckDB's SQL."""
