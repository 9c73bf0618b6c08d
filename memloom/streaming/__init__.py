"""Structured Streaming: delta feeds and record feeds."""
