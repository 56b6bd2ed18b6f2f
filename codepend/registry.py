"""All queries of the library and their SQL: modules in codepend.queries register them by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame, and SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: Modules of codepend.queries.
MODULES = ("selection", "dependence", "significance", "activity", "graph", "report")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.queries.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
