"""Registered queries: each runs an operator over whole tables, with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from streetbook.fixtures import Fixture, with_views

QUERIES: dict[str, Callable[[Fixture], DataFrame]] = {}
TWINS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build: Callable[[Fixture], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = build
        if sql is not None:
            TWINS[name] = with_views(sql)
        return build

    return add


def load() -> None:
    """Import every module that registers queries."""
    from catalog_queries import browse, classify, exports, extraction, merges, reports, texts, work  # noqa: F401


def runners() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def runner(build):
        return lambda spark, folder: build(Fixture(spark, folder))

    return {name: runner(build) for name, build in QUERIES.items()}
