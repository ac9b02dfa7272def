"""End-to-end plans, the query registry and its DuckDB oracle SQL."""
