"""Incremental ingest of newly arrived grid files."""
