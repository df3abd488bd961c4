"""A query and the decorator that registers it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


def registrar() -> tuple[dict[str, Query], Callable]:
    """A dict of queries and a decorator query(covers, sql) that adds a function under its name."""
    found: dict[str, Query] = {}

    def query(covers: str, sql: str | None):
        def add(run):
            found[run.__name__] = Query(run, sql, covers)
            return run

        return add

    return found, query
