"""Structured Streaming jobs for incremental ingestion."""
