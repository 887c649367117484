"""Column functions (all native Spark expressions): cleaners, date/time
parsing and filters, text helpers, and the per-table mapping registry."""
