"""Operators for preparing training data; each module holds one operator and its query.

Nothing outside this package imports it. ``registered`` gathers the queries and their SQL.
"""

from __future__ import annotations

import importlib

MODULES = [
    "packing", "quality", "scoring", "embeddings", "bytepairs",
    "jaccard", "chat", "sentences", "language", "suffixes", "webarchives", "infill", "merkle",
]


def registered() -> tuple[dict, dict]:
    """``(queries, sql)`` of all operators, by query name."""
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"sealyard.llm.{name}")
        queries.update(module.QUERIES)
        sql.update(getattr(module, "SQL", {}))
    return queries, sql
