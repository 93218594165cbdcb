"""Queries of this package: ``fn(spark, sf_dir)`` and, where SQL can express
one, its DuckDB statement."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""
    def note(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return note
