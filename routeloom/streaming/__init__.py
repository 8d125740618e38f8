"""Structured Streaming forms of the update operators."""
