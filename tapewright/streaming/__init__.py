"""Structured Streaming: bars from ticks."""
