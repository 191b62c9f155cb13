"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double, so that the last bits of a sum do not count."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def tied(c: str | Column, digits: int = 4) -> Column:
    """Rounding for means. Means of cents fall exactly between two roundings, where
    the last bit of a sum would decide, so that bit is rounded away first."""
    d = (F.col(c) if isinstance(c, str) else c).cast("double").cast("decimal(28,8)")
    return F.round(d, digits).cast("double")


def tied_sql(expression: str, digits: int = 4) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def ts(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
DAY = "strftime({}, '%Y-%m-%d')"
