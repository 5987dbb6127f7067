"""Registered queries: a name, a function over a table loader, and DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.fixtures import table, with_views

Loader = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``, where ``t(name)`` is a driver table or a fixture view; ``{view}`` in the SQL names a view."""

    def register(fn: Callable[[Loader], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table_name: table(spark, sf_dir, table_name))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return fn

    return register


def files_query(name: str, sql: str | None = None):
    """As ``query``, for a function that needs the session itself, to write files and read or stream them back: ``fn(spark, sf_dir, t)``."""

    def register(fn: Callable[[SparkSession, str, Loader], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, sf_dir, lambda table_name: table(spark, sf_dir, table_name))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return fn

    return register
