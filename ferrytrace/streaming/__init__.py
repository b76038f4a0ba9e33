"""Structured Streaming forms of the delivery work."""
