"""Structured Streaming ingest of the event log."""

from .ingest import event_stream, start_ingest  # noqa: F401
