"""The library's registered queries and, where SQL can state them, their DuckDB twins."""

from __future__ import annotations

import importlib

from paperloom.plans.catalog import ORACLES, QUERIES

for _name in ("text_queries", "search_queries", "evidence_queries", "knowledge_queries", "table_queries", "draft_queries", "asset_queries", "routing_queries", "stream_queries"):
    importlib.import_module(f"paperloom.plans.{_name}")

FLAGSHIP = "c6_bm25_topk"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
