"""Decisions over the manifest, and the registered queries."""
