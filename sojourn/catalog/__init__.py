"""Queries over the test tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "episodes",
    "history",
    "cohort_tables",
    "scores",
    "selection",
    "quality",
    "survival",
    "scalars",
    "splits",
    "models",
    "sinks",
)


class Registry:
    """Collects a module's queries under their function names."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn

        return add


def _registries() -> list[Registry]:
    return [import_module(f"sojourn.catalog.{m}").registry for m in MODULES]


def all_queries() -> dict[str, Query]:
    return {name: fn for r in _registries() for name, fn in r.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for r in _registries() for name, sql in r.sql.items()}
