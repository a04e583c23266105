"""Registered queries of the core and their SQL."""

from __future__ import annotations

from lakelens import core_queries, engine_queries, quality_queries

QUERIES: dict = core_queries.QUERIES | engine_queries.QUERIES | quality_queries.QUERIES
ORACLES: dict[str, str] = core_queries.ORACLES | engine_queries.ORACLES | quality_queries.ORACLES
