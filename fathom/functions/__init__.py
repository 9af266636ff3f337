"""Column expressions: periods, calendar features, array helpers, losses, metrics."""
