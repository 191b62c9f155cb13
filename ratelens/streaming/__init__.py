"""Structured Streaming forms of ingest, health and market aggregates."""
