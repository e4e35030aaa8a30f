"""Parsers of landed feeds, and sinks."""
