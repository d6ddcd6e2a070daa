"""Queries by name, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.adapters import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, adapters: bool = True):
    """Register ``f(tables)`` under its name; ``adapters``: the SQL reads items, terms, pairs or scores."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = with_tables(sql) if adapters else sql
        return f

    return wrap


def tok(x: str) -> str:
    """DuckDB: words between white space."""
    return f"[w FOR w IN string_split_regex(trim({x}), '\\s+') IF w <> '']"


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)
