"""Structured Streaming forms of the usage log."""
