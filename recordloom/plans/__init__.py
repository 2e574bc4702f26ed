"""Registered queries over the given tables."""

from __future__ import annotations

from recordloom.plans.registry import ORACLES, QUERIES, Query


def _load() -> None:
    from recordloom.plans import (  # noqa: F401
        extract_queries, graph_queries, scalar_queries, search_queries, store_queries, stream_queries,
    )


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
