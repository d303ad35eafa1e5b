"""Query registry: name -> (builder over a fixture directory, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from keyloom.sources.fixtures import VIEWS, Keyspace


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def oracle_sql(body: str, *views: str) -> str:
    """`body` with the named keyspace views as leading CTEs; the text is ANSI SQL that DuckDB runs."""
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return f"WITH {ctes} {body}" if ctes else body


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query whose function takes a Keyspace; views: space-separated CTE names used by sql."""

    def register(fn: Callable[[Keyspace], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, lambda spark, sf_dir: fn(Keyspace(spark, sf_dir)), sql and oracle_sql(sql, *views.split()))
        return fn

    return register
