"""Queries over the driver's tables, gathered from the modules of this package: name, Spark query, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "q3_price_details"
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with the SQL that DuckDB can run for the same rows."""

    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _gather() -> None:
    from . import business, consolidation, graphs, matching, offers, relational, rollups, search, shopping, social  # noqa: F401  their functions register themselves


def queries() -> dict[str, Callable]:
    _gather()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _gather()
    return dict(_SQL)
