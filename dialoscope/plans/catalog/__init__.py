"""Registry of checked queries: a Spark callable and, where SQL can say it, the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries with their oracle text."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name!r} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn
        return register


def load() -> Catalog:
    """All queries of all areas."""
    merged = Catalog()
    for part in areas():
        for name, fn in part.queries.items():
            merged.add(name, part.oracles.get(name))(fn)
    return merged


def areas() -> list[Catalog]:
    import importlib
    import pkgutil

    import dialoscope.plans.catalog as package
    names = sorted(m.name for m in pkgutil.iter_modules(package.__path__))
    return [importlib.import_module(f"{package.__name__}.{n}").CATALOG for n in names]
