"""Readers and artifact sinks."""
