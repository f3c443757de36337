"""All queries by name, and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "ann_category_filter"


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with the SQL that returns its rows."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put
