"""The registered queries."""

from __future__ import annotations

from importlib import import_module

from shelfspark.plans.registry import ORACLES, QUERIES

MODULES = ("feed_queries", "catalog_queries", "quality_queries", "search_queries",
           "evaluation_queries", "answer_queries", "telemetry_queries", "stream_queries", "retrieval_queries")


def _load() -> None:
    for module in MODULES:
        import_module(f"shelfspark.plans.{module}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
