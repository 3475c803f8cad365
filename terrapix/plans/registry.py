"""Where queries of the raster and pyramid engine are registered, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.tables import with_views

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(spark, sf_dir) under a name, with the DuckDB SQL that gives the same rows."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return put
