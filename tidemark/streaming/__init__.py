"""Structured Streaming twins of operators on events."""
