"""All queries of the engine and their DuckDB statements, by name."""

from __future__ import annotations

from . import delivery_queries, engine_queries, record_queries, review_queries, store_queries, symbol_queries, tool_queries

_MODULES = (review_queries, engine_queries, symbol_queries, tool_queries, delivery_queries, store_queries, record_queries)
CATALOG = {name: f for m in _MODULES for name, f in m.Q.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.O.items()}
