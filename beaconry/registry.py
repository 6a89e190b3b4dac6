"""All queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from beaconry.plans.queries import ORACLE, QUERIES

FLAGSHIP = "bm25_docs_top20"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
