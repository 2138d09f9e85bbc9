"""Structured Streaming versions of the daily roll-up and warnings."""
