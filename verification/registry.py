"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayloom.session import tune
from stayloom.sources.roles import Roles
from verification.role_sql import with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **ctes: str):
    """Register ``fn(roles)`` under ``name``; with ``sql`` it is compared value by value."""

    def wrap(fn: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Roles(tune(spark), folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_roles(sql, **ctes)
        return fn

    return wrap


def r8(col: Column | str) -> Column:
    """Round away the digits that depend on summation order."""
    return F.round(col, 8)


def r8_all(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r8(c) for c in columns})
