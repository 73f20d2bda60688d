"""Streaming ingest of packaged books."""
