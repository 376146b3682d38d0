"""Registered queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(tables) -> DataFrame`` under ``name``."""
    from checks.tables import Tables

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six digits, without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name or column) if (name or isinstance(column, str)) else out


def s6(expression: str, name: str) -> str:
    """The same in SQL."""
    return f"round({expression}, 6) + 0.0 AS {name}"
