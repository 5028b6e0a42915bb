"""Operators for training data at scale, with their queries and SQL; nothing else in the library imports them."""

from . import alignment, decontaminate, html, jaccard, langid, licenses, linededup, mixing, quality, repair, sharding, substring, toxicity  # noqa: F401
from .data import LLM_ORACLES, LLM_QUERIES

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
