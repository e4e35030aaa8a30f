"""Structured Streaming forms of the event pipeline."""
