"""Queries by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Callable], Callable]:
    def keep(query: Callable) -> Callable:
        k = name or query.__name__
        QUERIES[k] = query
        if sql:
            ORACLE_SQL[k] = sql
        return query

    return keep
