"""All registered queries."""

from __future__ import annotations

from cairnfield.plans import audit_queries, guard_queries, panel_queries, score_queries, store_queries, stream_queries  # noqa: F401  they register themselves
from cairnfield.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
