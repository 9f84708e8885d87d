"""Structured Streaming forms of the meter and of the event feed."""
