"""Streaming ingest."""

from .ingest import stream_lines_into

__all__ = ["stream_lines_into"]
