"""Structured Streaming forms of the validators."""
