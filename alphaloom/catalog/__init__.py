"""Registered queries with their SQL twins."""

from __future__ import annotations

from alphaloom.catalog.base import IDS, QUERIES, SQL, resolve_sql  # noqa: F401


def load() -> None:
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    resolve_sql()
