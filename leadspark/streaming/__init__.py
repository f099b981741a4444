"""Incremental ingest of raw-record files."""
