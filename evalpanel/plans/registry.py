"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Fixed result types: doubles rounded without negative zero, integers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            r = F.round(c.cast("double"), DIGITS)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def D(expr: str, name: str) -> str:
    """SQL for a rounded double result column."""
    r = f"round(CAST({expr} AS DOUBLE), {DIGITS})"
    return f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {name}"


def N(expr: str, name: str) -> str:
    """SQL for an integer result column."""
    return f"CAST({expr} AS BIGINT) AS {name}"
