"""Incremental ingest: the same parsers and normalisers on file streams."""
