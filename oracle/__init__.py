"""Independent SQL statements of every query, for an ANSI-style SQL engine (DuckDB)."""
