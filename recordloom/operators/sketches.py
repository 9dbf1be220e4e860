"""Distinct counts that merge: one sketch per entity and period, stored with the load.

``add`` aggregates a load to one HyperLogLog sketch per key, period and counted column. Sketches of any
periods and loads merge without the rows they came from, so a window over years reads a few
kilobytes per key instead of all values, and a value that occurs in several periods or loads counts once.
``window`` merges all stored periods that fit, ``rolling`` the last so many periods up to each period;
``exact_rolling`` counts the same from the rows, and ``compared`` puts both beside each other.

A sketch has ``2 ** lg_k`` registers and a relative standard error of about ``1.04 / 2 ** (lg_k / 2)``, 0.8 % at the
default of 14. All sketches of a store must have the same ``lg_k``. Adding a batch again replaces it.

Null values are not counted and a key without values counts 0; rows with a null period belong to no
window. An empty load stores no sketch. A store that was never added to is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shape import as_list

LG_K = 14


@dataclass(frozen=True)
class DistinctStore:
    """Stored sketches: their folder, the key columns, the period (a whole number) and the counted columns."""
    spark: SparkSession
    path: str
    keys: list[str]
    period: str
    counted: list[str]
    lg_k: int = LG_K

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select(*self.keys, self.period, *self.counted)


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / 2 ** (lg_k / 2)


def add(store: DistinctStore, rows: DataFrame, batch: str) -> None:
    """Store the sketches of one load; a batch of that name is replaced."""
    if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"a batch is named by letters, digits, dots, dashes and underscores: {batch!r}")
    rows.groupBy(*as_list(store.keys), store.period).agg(*[
        F.hll_sketch_agg(F.col(c).cast("string"), F.lit(store.lg_k)).alias(c) for c in store.counted]
    ).write.mode("overwrite").parquet(f"{store.path}/batch={batch}")


def _merged(rows: DataFrame, by: list[str], counted: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[
        F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in counted])


def window(store: DistinctStore, first: int | None = None, last: int | None = None,
           by: list[str] | None = None) -> DataFrame:
    """Estimates over the periods from ``first`` to ``last``, per key or for some of the key columns."""
    p, rows = F.col(store.period), store.read().where(F.col(store.period).isNotNull())
    if first is not None:
        rows = rows.where(p >= first)
    if last is not None:
        rows = rows.where(p <= last)
    return _merged(rows, store.keys if by is None else by, store.counted)


def _spread(rows: DataFrame, keys: list[str], period: str, length: int) -> DataFrame:
    """Every row under each period whose window holds it, for periods in which its key has rows."""
    if length < 1:
        raise ValueError("a window holds at least one period")
    there = rows.select(*keys, period).where(F.col(period).isNotNull()).distinct()
    reach = rows.where(F.col(period).isNotNull()).withColumn(
        period, F.explode(F.sequence(F.col(period), F.col(period) + F.lit(length - 1))))
    same: Column = F.col(f"r.{period}") == F.col(f"t.{period}")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    return reach.alias("r").join(there.alias("t"), same, "left_semi")


def rolling(store: DistinctStore, length: int) -> DataFrame:
    """Estimates per key and period over that and the ``length - 1`` periods before it."""
    spread = _spread(store.read(), store.keys, store.period, length)
    return _merged(spread, [*store.keys, store.period], store.counted)


def exact_rolling(rows: DataFrame, keys: list[str], period: str, counted: list[str], length: int) -> DataFrame:
    """The counts that ``rolling`` estimates, from the rows. A value travels once per key and period."""
    spread = _spread(rows.select(*keys, period, *counted).distinct(), keys, period, length)
    return spread.groupBy(*keys, period).agg(*[F.count_distinct(c).alias(c) for c in counted])


def compared(exact: DataFrame, estimated: DataFrame, by: list[str], counted: list[str],
             lg_k: int = LG_K, errors: float = 4.0) -> DataFrame:
    """Per row of ``exact``: its counts, ``<column>_estimate`` and ``<column>_within``, whether the estimate is no
    further off than ``errors`` standard errors (or half a value, as estimates are whole numbers)."""
    same = None
    for k in by:
        term = F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}"))
        same = term if same is None else same & term
    out = []
    for c in counted:
        off = F.abs(F.col(f"s.{c}") - F.col(f"e.{c}"))
        out += [F.col(f"e.{c}").alias(c), F.col(f"s.{c}").alias(f"{c}_estimate"), F.coalesce(
            off <= F.greatest(F.lit(0.5), F.col(f"e.{c}") * errors * standard_error(lg_k)),
            F.lit(False)).alias(f"{c}_within")]
    return exact.alias("e").join(estimated.alias("s"), same, "left").select(
        *[F.col(f"e.{k}").alias(k) for k in by], *out)
