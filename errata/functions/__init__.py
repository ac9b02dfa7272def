"""Column expressions (all native Spark; no Python per row)."""
