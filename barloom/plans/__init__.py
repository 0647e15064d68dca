"""Registered queries with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

from barloom.plans.registry import ORACLES, QUERIES, Query

_MODULES = ["bar_queries", "indicator_queries", "graph_queries", "label_queries", "signal_queries", "metric_queries", "audit_queries", "model_queries", "stream_queries", "source_queries", "flagship"]


def _load() -> None:
    for m in _MODULES:
        import_module(f"barloom.plans.{m}")


def all_queries() -> dict[str, Query]:
    _load()
    return QUERIES


def all_sql() -> dict[str, str]:
    _load()
    return ORACLES
