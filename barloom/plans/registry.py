"""The catalogue of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


CATALOGUE: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, base_dir)``; ``ids`` are the inventory lines it covers."""
    def wrap(fn):
        if name in CATALOGUE:
            raise ValueError(f"{name} is registered twice")
        CATALOGUE[name] = Query(fn, sql, tuple(ids.split()))
        return fn
    return wrap
