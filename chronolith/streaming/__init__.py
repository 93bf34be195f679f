"""Structured Streaming variants of ingest and rollups."""
