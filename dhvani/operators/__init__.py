"""DataFrame operators (joins, aggregations, windows, splits, scoring)."""
