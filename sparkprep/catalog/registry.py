"""Name -> (Spark query, DuckDB oracle) registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from sparkprep.catalog.tables import with_fixtures

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, fixtures: Sequence[str] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the oracle (fixture views named in ``fixtures`` are prepended as CTEs)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, fixtures)
        return fn
    return deco
