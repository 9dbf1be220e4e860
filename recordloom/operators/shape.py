"""Small building blocks shared by the operators: ranking, keep-first, list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def as_list(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def ranked(df: DataFrame, order, limit: int | None) -> DataFrame:
    """The top ``limit`` rows. Without a limit the rows come back unsorted.

    ``order`` must end in a unique key so that ties at the cut are settled.
    """
    return df if limit is None else df.orderBy(*order).limit(limit)


def top_k_per_key(df: DataFrame, keys, order, k: int, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows of every key.

    A ``row_number() <= k`` filter is cut down to k rows per key inside every
    map task before the shuffle, so a hot key never travels whole.
    """
    name = rank_col or "_rn"
    window = Window.partitionBy(*as_list(keys)).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_k_per_key(df, keys, order, 1)


def joined_set(value, sep: str = " | ") -> Column:
    """Aggregate: distinct non-null values, sorted and joined; null if there are none.

    Sets are merged map-side, so only distinct values travel. Used on groups
    that survived a ranking.
    """
    c = F.col(value) if isinstance(value, str) else value
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c.cast("string"))), sep), F.lit(""))


def decorate(top: DataFrame, rows: DataFrame, keys, *aggs) -> DataFrame:
    """Add aggregates over ``rows`` to the ranked groups in ``top``.

    Only rows of the ranked groups are aggregated: ``top`` is a short ranking, so
    the planner can ship it to the rows instead of shuffling them. Keys may be
    null. Every ranked group has rows, since the ranking was made from them.
    """
    keys = as_list(keys)
    others = [c for c in top.columns if c not in keys]
    wanted = top.withColumnsRenamed({c: f"_top_{c}" for c in top.columns})
    cond = None
    for k in keys:
        hit = rows[k].eqNullSafe(wanted[f"_top_{k}"])
        cond = hit if cond is None else cond & hit
    grouped = rows.join(wanted, cond).groupBy(
        *keys, *[F.col(f"_top_{c}") for c in others]).agg(*aggs)
    return grouped.withColumnsRenamed({f"_top_{c}": c for c in others})


def pct_change(new, old, digits: int = 1) -> Column:
    """Percentage change, null unless the old value is positive."""
    new, old = F.col(new).cast("double"), F.col(old).cast("double")
    return F.when(old > 0, F.round(F.lit(100.0) * (new - old) / old, digits))


def safe_ratio(num: Column, den: Column) -> Column:
    """Quotient, null unless the divisor is positive."""
    return F.when(den > 0, num / den)


def quarter_number(period) -> Column:
    """Quarter 1..4 from a spelled period (``second_quarter``); null if it is none."""
    c = F.col(period) if isinstance(period, str) else period
    out = None
    for n, word in enumerate(("first", "second", "third", "fourth"), start=1):
        hit = F.startswith(c, F.lit(word))
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out


def quarter_ordinal(year, quarter) -> Column:
    """A period number in which consecutive quarters differ by one."""
    return F.col(year) * 4 + quarter


def desc(*cols) -> list[Column]:
    return [F.desc_nulls_last(c) for c in cols]


def asc(*cols) -> list[Column]:
    return [F.asc_nulls_last(c) for c in cols]


def row_index(df: DataFrame, parent: str, order: list[str], alias: str) -> DataFrame:
    """0-based position of a row among its parent's rows.

    The first order column splits every parent into slices. Slice sizes are
    counted with map-side combine and turned into offsets, and only the rows of
    one slice are numbered together, so one big parent spreads over its slices.
    """
    slices = df.groupBy(parent, order[0]).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(parent).orderBy(order[0]).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = slices.select(
        F.col(parent).alias("_parent"), F.col(order[0]).alias("_slice"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(parent, order[0]).orderBy(*order[1:])
    return (
        df.join(offsets, (F.col(parent) == F.col("_parent"))
                & (F.col(order[0]) == F.col("_slice")))
        .withColumn(alias, (F.col("_offset") + F.row_number().over(within) - 1).cast("int"))
        .drop("_parent", "_slice", "_offset")
    )


def exact_quantile(df: DataFrame, column: str, share: float) -> DataFrame:
    """One row with the least value (``floor``) that at least ``share`` of the non-null values do not exceed.

    Values are counted, the distinct ones sorted in ranges, and the counts summed range by range, so
    that only the range that holds the answer is summed value by value.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(counts.repartitionByRange(parts, "_v").withColumn("_p", F.spark_partition_id()))
    sums = placed.groupBy("_p").agg(F.sum("_n").alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    need = placed.agg(F.ceil(F.sum("_n") * F.lit(share)).alias("x")).scalar()
    found = (
        sums.withColumns({"_before": F.coalesce(F.sum("_s").over(before), F.lit(0)), "_need": F.greatest(need, F.lit(1))})
        .where((F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_s") >= F.col("_need"))))
    inside = placed.join(found, "_p").withColumn(
        "_at", F.col("_before") + F.sum("_n").over(Window.partitionBy("_p").orderBy("_v")))
    return inside.where(F.col("_at") >= F.col("_need")).agg(F.min("_v").alias("floor"))
