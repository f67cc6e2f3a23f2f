"""Column -> Column building blocks (all native Spark expressions)."""
