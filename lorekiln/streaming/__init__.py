"""Incremental indexing as a structured stream."""
