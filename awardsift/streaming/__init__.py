"""Scoring and roll-up of awards as they land."""

from .rollup import current_awards, rollup_stream
from .score import score_stream

__all__ = ["current_awards", "rollup_stream", "score_stream"]
