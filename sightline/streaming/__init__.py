"""Structured Streaming: capture ingest, stateful dedupe, live counts, weekly trend."""

from .ingest import ingest_batch, stream_captures
from .counts import stream_dedupe, stream_live_counts, stream_weekly_trend

__all__ = ["ingest_batch", "stream_captures", "stream_dedupe", "stream_live_counts", "stream_weekly_trend"]
