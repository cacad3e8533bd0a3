"""Operators on DataFrames: flight building, enrichment, joins, rollups, lookups, writes and exports."""
