"""Readers and sinks. Each has a file part and a pure DataFrame part."""
