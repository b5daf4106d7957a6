"""All queries. Importing this package fills the registry."""

from __future__ import annotations

from . import analytics, rest, retrieval, text
from .registry import ORACLES, PLANS

FLAGSHIP = PLANS["hyb_3_ranked_search"]
__all__ = ["FLAGSHIP", "ORACLES", "PLANS", "analytics", "rest", "retrieval", "text"]
