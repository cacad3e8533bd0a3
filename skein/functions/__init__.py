"""Column functions: geometry, time series in rows, identifiers and codes."""
