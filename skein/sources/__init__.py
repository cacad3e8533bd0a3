"""Readers of raw reports, airframes, aeronautical features, pressure and terrain."""
