"""Streaming extension: append-only ingestion of audit records."""
