"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from silvaspan.operators.skew import HEAVY, spread_join

__all__ = ["HEAVY", "spread_join"]
