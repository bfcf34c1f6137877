"""Named queries, each with the SQL that means the same where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from landq.plans.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    streaming: bool


CATALOGUE: dict[str, Entry] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None, streaming: bool = False):
    """Register a query under a name; ``views`` are the fixture views its SQL reads."""

    def register(run: Query) -> Query:
        assert name not in CATALOGUE, name
        CATALOGUE[name] = Entry(run, None if sql is None else oracle(views or [], sql), streaming)
        return run

    return register
