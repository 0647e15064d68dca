"""Structured Streaming forms of the bar, fill and signal operators."""
