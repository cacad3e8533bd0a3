"""Streaming forms of the flight builder."""
