"""External tables whose earlier pulls stay readable.

A pull is a partition ``_as_of``; storing one touches no other. Any day can be read as it was known then, each record
can be followed over its states, and two pulls can be compared, all from what is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import sinks

AS_OF = "_as_of"


def store(df: DataFrame, name: str, warehouse: str, *, url: str, as_of: str) -> DataFrame:
    """Store a pull and log it; a pull of the same day replaces that day's. Returns the pull as stored."""
    spark = df.sparkSession
    path = f"{warehouse}/{name}"
    # the day is the folder's name, so other pulls stay as they are
    sinks.full_refresh(df.drop(AS_OF), f"{path}/{AS_OF}={as_of}")
    stored = pulls(spark, name, warehouse).where(F.col(AS_OF) == F.lit(as_of).cast("date"))
    sinks.log_vintage(stored, name, url, as_of, f"{warehouse}/_vintages")
    return stored


def pulls(spark: SparkSession, name: str, warehouse: str) -> DataFrame:
    """All pulls, each row with its day; columns that came later are null before."""
    return spark.read.option("mergeSchema", True).parquet(f"{warehouse}/{name}").withColumn(AS_OF, F.col(AS_OF).cast("date"))


def known_on(stored: DataFrame, day: str | Column) -> DataFrame:
    """The latest pull up to a day, without its day; no pull by then gives no row."""
    day = (F.lit(day) if isinstance(day, str) else day).cast("date")
    last = stored.where(F.col(AS_OF) <= day).agg(F.max(AS_OF)).scalar()
    return stored.where(F.col(AS_OF) == last).drop(AS_OF)


def _state(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def intervals(stored: DataFrame, key: list[str]) -> DataFrame:
    """Each state of each record with ``valid_from`` and ``valid_to`` (exclusive, null while it holds).

    A state holds from the first pull that shows it to the first that does not; a record that is missing from a pull
    has ended, and starts anew if it comes back. Rows of one key in one pull are told apart by their other columns, and count once
    if they are equal.
    """
    others = [c for c in stored.columns if c != AS_OF]
    days = stored.select(AS_OF).distinct()
    order = Window.orderBy(AS_OF)
    # one row per pull
    days = days.select(AS_OF, F.row_number().over(order).alias("_n"), F.lead(AS_OF).over(order).alias("_next"))
    rows = stored.withColumn("_state", _state(others)).groupBy(AS_OF, *key, "_state").agg(
        *[F.first(c).alias(c) for c in others if c not in key]).join(days, AS_OF)
    per_state = Window.partitionBy(*key, "_state").orderBy("_n")
    runs = rows.withColumn("_run", F.col("_n") - F.row_number().over(per_state))
    return runs.groupBy(*key, "_state", "_run").agg(
        *[F.first(c).alias(c) for c in others if c not in key], F.min(AS_OF).alias("valid_from"),
        F.max_by("_next", "_n").alias("valid_to")).select(*others, "valid_from", "valid_to")


def holding_on(history: DataFrame, day: str | Column) -> DataFrame:
    """The states of ``intervals`` that hold on a day, a value or a column of the frame."""
    day = (F.lit(day) if isinstance(day, str) else day).cast("date")
    return history.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))


def difference(stored: DataFrame, key: list[str], before: str, after: str) -> DataFrame:
    """What changed between two stored pulls: ``key, change`` (added, removed, changed) and the number of columns that differ."""
    others = [c for c in stored.columns if c not in (AS_OF, *key)]

    def at(day, side):
        pull = stored.where(F.col(AS_OF) == F.lit(day).cast("date"))
        return pull.select(*[F.col(c).alias(f"{side}_{c}") for c in (*key, *others)], F.lit(True).alias(f"{side}_there"))

    same = None
    for c in key:
        one = F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        same = one if same is None else same & one
    changed = F.lit(0)
    for c in others:
        changed = changed + (~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("int")
    both = at(before, "a").join(at(after, "b"), same, "full_outer")
    kind = F.when(F.col("a_there").isNull(), "added").when(F.col("b_there").isNull(), "removed").when(changed > 0, "changed")
    return both.withColumn("change", kind).where("change IS NOT NULL").select(
        *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in key], "change",
        F.when(F.col("change") == "changed", changed).otherwise(F.lit(len(others))).cast("long").alias("n_columns"))
