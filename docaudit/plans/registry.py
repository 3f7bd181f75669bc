"""Registry of the named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docaudit.plans.fixtures import Fixtures, with_views
from docaudit.shared import prepare


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Fixtures(prepare(spark), sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query. ``sql`` is the same question for the check engine."""

    def register(build: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, with_views(sql) if sql else None)
        return build

    return register


def query_like(name: str, other: str):
    """Register a query that has the same check SQL as another one."""

    def register(build: Callable[[Fixtures], DataFrame]):
        query(name)(build)
        QUERIES[name] = Query(name, build, QUERIES[other].sql)
        return build

    return register
