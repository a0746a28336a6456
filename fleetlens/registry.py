"""All queries of the library by name, and their SQL for DuckDB."""

from __future__ import annotations

from fleetlens.plans import engine_queries, exposure_queries, network_queries, portfolio_queries, study_queries

MODULES = (exposure_queries, portfolio_queries, engine_queries, study_queries, network_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE.items()}
