"""Registry: one entry per query, with the operator ids it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from alphaloom.catalog.ctes import with_ctes
from alphaloom.sources.tables import Tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
IDS: dict[str, tuple[str, ...]] = {}
_PENDING: dict[str, tuple[str, list[str]]] = {}


def resolve_sql() -> None:
    """Compose the SQL twins once all fragments are defined."""
    for name, (sql, ctes) in _PENDING.items():
        SQL[name] = with_ctes(sql, ctes)


def query(name: str, ids: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(tables) -> DataFrame`` and its SQL twin over the same tables."""
    def deco(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        IDS[name] = tuple(ids.split())
        if sql is not None:
            _PENDING[name] = (sql, ctes.split())
        return fn
    return deco
