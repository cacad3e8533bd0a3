"""Predicates, the query engine, and the daily build."""
