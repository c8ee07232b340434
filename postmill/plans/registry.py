"""Names of the registered queries, their Spark builders and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.plans.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, *views: str) -> str:
    """Prefix a statement with the views it reads and those they read."""
    needed: list[str] = []

    def add(name: str) -> None:
        requires, body = VIEWS[name]
        for other in requires:
            add(other)
        entry = f"{name} AS ({body})"
        if entry not in needed:
            needed.append(entry)

    for view in views:
        add(view)
    if not needed:
        return sql
    # Harmless where nothing recurs.
    return "WITH RECURSIVE " + ",\n".join(needed) + "\n" + sql


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; without SQL it is checked by rows and by tests only."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register
