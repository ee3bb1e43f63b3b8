"""Registry of the queries the engine is checked with, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked here, by a brute-force test."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch(c: str | Column) -> Column:
    """Unix seconds of a zone-less timestamp, whatever the session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c)


def with_ctes(names: dict[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in names.items()) + "\n" + body
