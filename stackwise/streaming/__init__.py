"""Structured Streaming helpers (stateless scoring of arriving rows)."""

from stackwise.streaming.score import score_stream, write_scores

__all__ = ["score_stream", "write_scores"]
