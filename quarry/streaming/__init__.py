"""Structured Streaming forms of the token operators (same plans as batch)."""

from quarry.streaming.tokens import (  # noqa: F401
    hour_counts, log_stream, stream_table, token_counts, run_available_now)
