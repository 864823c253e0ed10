"""Streaming forms of series operators."""
