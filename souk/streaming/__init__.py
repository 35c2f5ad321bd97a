"""Structured Streaming operators and their sinks."""
