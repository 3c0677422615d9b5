"""Named queries; importing a query module registers its queries."""

from __future__ import annotations

import importlib

MODULES = ["text_queries", "table_queries", "search_queries", "people_queries", "stream_queries"]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")


def queries() -> dict:
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    from .registry import ORACLE

    _load()
    return dict(ORACLE)
