"""Queries of the catalogue and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.spread import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL where SQL can express it."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


#: Tables whose rows are worth more work than the exchange that spreads them.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def inline(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A literal relation, written as the SQL VALUES list that its SQL uses too."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")
