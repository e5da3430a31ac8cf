"""The registry of queries: each is a plan over the driver's tables, with the same answer in DuckDB SQL where SQL can give it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from tessera.plans import curation, files, measures, models, privacy, taxonomy, texts, vectors  # noqa: F401

    return QUERIES, SQL
