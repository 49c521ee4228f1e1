"""Structured Streaming forms of quote arrival."""
