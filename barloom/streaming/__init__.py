"""Structured Streaming jobs over quote snapshots."""
