"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_QUERIES: dict[str, Callable] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and its DuckDB SQL."""

    def add(fn: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return add


MODULES = ("source_queries", "factor_queries", "adapter_queries", "csharp_queries", "scalar_queries", "extract_queries", "language_queries", "graph_queries", "select_queries", "render_queries", "candidate_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"sparkloom.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
