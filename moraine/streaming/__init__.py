"""Ingest of mutation streams."""
