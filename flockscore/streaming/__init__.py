"""Continuous ingestion and re-scoring with Structured Streaming."""
