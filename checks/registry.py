"""Collects queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom.plans.testdata import TestTables, with_prelude
from recordloom.session import tune

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, prelude: bool = True):
    """Register ``fn(tables) -> DataFrame`` and, if it has one, its SQL."""
    def add(fn):
        QUERIES[name] = lambda spark, path: fn(TestTables(tune(spark), path))
        if sql is not None:
            SQL[name] = with_prelude(sql) if prelude else sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 2, **per_column: int) -> DataFrame:
    """Round all double columns, so that the order of summation does not show."""
    for name, kind in df.dtypes:
        if kind == "double":
            df = df.withColumn(name, F.round(name, per_column.get(name, digits)))
    return df
