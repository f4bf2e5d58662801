"""All queries of the library and their SQL."""

from __future__ import annotations

from .plans import aggregate_plans, domain_plans, graph_plans, relational_plans, sources_plans  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
