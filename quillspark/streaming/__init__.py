"""Structured Streaming variants of ingestion and indexing."""
