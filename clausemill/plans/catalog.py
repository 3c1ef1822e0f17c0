"""All queries of the core engine; importing a module registers its queries."""

from __future__ import annotations

from clausemill.plans import flow_queries, label_queries, table_queries, text_queries  # noqa: F401
from clausemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
