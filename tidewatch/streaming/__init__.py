"""Structured Streaming forms of detectors and windowed aggregates."""
