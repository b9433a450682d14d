"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the function under ``name``, with DuckDB SQL for the same rows if there is one."""

    def wrap(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return wrap


def _load() -> None:
    from cairnflow.plans import library  # noqa: F401  (fills the registry)


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
