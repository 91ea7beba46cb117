"""Structured Streaming forms of ingestion, change detection and windowed aggregates."""
