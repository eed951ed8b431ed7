"""Named queries over the driver tables with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = fn
    if sql is not None:
        _ORACLES[name] = sql


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """What is registered so far; for queries that are made of others."""
    return _QUERIES


def registered_sql() -> dict[str, str]:
    return _ORACLES


def _load() -> None:
    from wayfare import plans  # noqa: F401  registers on import


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
