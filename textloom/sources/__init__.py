"""Readers: packaged books and the block views of flat tables."""
