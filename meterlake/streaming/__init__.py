"""Transcripts as a stream: the same tables, kept up by micro-batches."""

from meterlake.streaming.tail import collect_available, stream_lines

__all__ = ["collect_available", "stream_lines"]
