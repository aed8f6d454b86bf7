"""Incremental ingest of pixels with Structured Streaming."""
