"""SQL for DuckDB that computes the registered queries independently of Spark."""
