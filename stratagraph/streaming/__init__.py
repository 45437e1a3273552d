"""Structured Streaming: incremental ingest of profiles."""
