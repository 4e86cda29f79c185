"""Registered queries: each pairs a Spark plan with the same result as SQL."""

from __future__ import annotations

from . import derived, joins, market, models, research, scans, studies, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "derived", "joins", "market", "models", "research", "scans", "studies", "text"]
