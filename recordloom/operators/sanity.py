"""Checks after a load: row counts, keys, coverage of bridge columns, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .relate import top_countries


def _metric(df: DataFrame, check: str, detail, value) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), detail.cast("string").alias("detail"),
                     value.cast("double").alias("value"))


def table_checks(df: DataFrame, name: str, key: str | None = None, covered=()) -> DataFrame:
    """Row count, null keys and coverage (percent of rows in which a column is set, to one decimal) of a table,
    in one scan."""
    aggs = [F.count("*").alias("_n"), *[F.count(c).alias(f"_c{k}") for k, c in enumerate([key, *covered]) if c]]
    n = F.col("_n")
    found = [("rows", name, n)]
    if key:
        found.append(("null_keys", f"{name}.{key}", n - F.col("_c0")))
    found += [("coverage_pct", c, F.when(n > 0, F.round(F.lit(100.0) * F.col(f"_c{k}") / n, 1)))
              for k, c in enumerate(covered, 1)]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(check).alias("check_name"), F.lit(detail).alias("detail"), value.cast("double").alias("value"))
        for check, detail, value in found])))


def rows_per(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return _metric(n, f"rows_per_{column}", F.col(column), F.col("n"))


def distinct_with(df: DataFrame, ident: str, column: str) -> DataFrame:
    """Distinct ids, and those of them that carry the column."""
    n = df.groupBy(ident).agg(F.max(F.col(column).isNotNull().cast("int")).alias("has")).where(
        F.col(ident).isNotNull()).agg(F.count("*").alias("n"), F.sum("has").alias("k"))
    return n.select(F.inline(F.array(*[
        F.struct(F.lit(check).alias("check_name"), F.lit(detail).alias("detail"),
                 F.coalesce(value, F.lit(0)).cast("double").alias("value"))
        for check, detail, value in (("distinct", ident, F.col("n")),
                                     ("distinct_with", f"{ident}+{column}", F.col("k")))])))


def frequent_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return _metric(top_countries(df, column, n), f"top_{column}", F.col(column), F.col("n"))
