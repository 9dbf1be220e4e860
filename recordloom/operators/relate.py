"""Joins and aggregates around the detectors: registries, awards, amendments, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import normalize_name
from .shape import as_list, asc, desc, keep_first, ranked, top_k_per_key


def registry_gap(left: DataFrame, right: DataFrame, left_name: str, right_name: str,
                 key=normalize_name) -> DataFrame:
    """Names of either registry by key, with the side that holds them.

    ``side`` is ``both``, ``left_only`` or ``right_only``; the gap of one
    registry is a filter on it.
    """
    a = left.select(key(left_name).alias("name_key"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(key(right_name).alias("name_key"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    return (
        a.unionByName(b).where(F.col("name_key").isNotNull())
        .groupBy("name_key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .select("name_key", F.when((F.col("l") == 1) & (F.col("r") == 1), "both")
                .when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))
    )


def registry_gap_counts(gap: DataFrame) -> DataFrame:
    """Size of the registries, their overlap and both gaps, in one row."""
    side = F.col("side")
    return gap.agg(
        F.count_if(side != "right_only").alias("n_left"),
        F.count_if(side != "left_only").alias("n_right"),
        F.count_if(side == "both").alias("n_both"),
        F.count_if(side == "left_only").alias("n_left_only"),
        F.count_if(side == "right_only").alias("n_right_only"))


def country_mismatch(left: DataFrame, right: DataFrame, *, left_name: str, right_name: str,
                     left_country: str, right_country: str, key=normalize_name) -> DataFrame:
    """Names in both registries whose countries never agree there."""
    a = left.select(key(left_name).alias("name_key"), F.col(left_country).alias("country"),
                    F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(key(right_name).alias("name_key"), F.col(right_country).alias("country"),
                     F.lit(0).alias("l"), F.lit(1).alias("r"))
    pairs = (
        a.unionByName(b).where(F.col("name_key").isNotNull() & F.col("country").isNotNull())
        .groupBy("name_key", "country").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    return (
        pairs.groupBy("name_key").agg(
            F.sum("l").alias("n_left_countries"), F.sum("r").alias("n_right_countries"),
            F.max(F.col("l") * F.col("r")).alias("_agree"))
        .where((F.col("n_left_countries") > 0) & (F.col("n_right_countries") > 0)
               & (F.col("_agree") == 0))
        .drop("_agree")
    )


def amendment_collapsed_sum(filings: DataFrame, *, entity, period, posted: str, value: str,
                            tie: str) -> DataFrame:
    """Total per entity over its periods: latest version of each period against all as filed."""
    entity, period = as_list(entity), as_list(period)
    v = F.coalesce(F.col(value), F.lit(0.0))
    last = F.max_by(v, F.struct(posted, tie))
    return (
        filings.groupBy(*entity, *period)
        .agg(F.sum(v).alias("_filed"), last.alias("_last"), F.count("*").alias("_n"))
        .groupBy(*entity)
        .agg(F.sum("_filed").alias("as_filed_total"), F.sum("_last").alias("collapsed_total"),
             F.sum("_n").alias("n_filings"), F.count("*").alias("n_periods"))
    )


def first_award_after(engagements: DataFrame, awards: DataFrame, *, key: str, start: str,
                      awarded: str, tie: str, keep=()) -> DataFrame:
    """The first award at or after the earliest start of each key; ``next_awards`` pairs every engagement.

    Awards before an engagement are filtered in the join, and the earliest of the
    rest is kept with a map-side minimum.
    """
    begin = engagements.groupBy(key).agg(F.min(start).alias(start))
    row = F.struct(awarded, tie, *keep)
    return (
        awards.join(begin, key).where(F.col(awarded) >= F.col(start))
        .groupBy(key, start).agg(F.min(row).alias("_a"))
        .select(key, start, "_a.*")
    )


def next_awards(engagements: DataFrame, awards: DataFrame, *, key: str, start: str, awarded: str, tie: str, keep=(),
                span: str = "day") -> DataFrame:
    """Every engagement with the first award of its key at or after its start, or nulls: ``awarded``, ``tie`` and ``keep``.

    Engagements and awards of a key and span of time are passed once, the latest first, and each engagement takes the award seen last. Where
    its own span has none left, it takes the first award of a later span, carried back over one row per key and span. So no key
    comes together in one task, only what one key has in one span. Awards of equal time go by ``tie``. An engagement without key or start
    has no award, an award without key or time pairs with nothing.
    """
    of_award = F.struct(F.col(awarded).alias("_at"), F.col(tie).alias("_tie"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)])
    of_engagement = F.struct(*engagements.columns)
    asked = engagements.select(F.col(key).alias("_key"), F.col(start).alias("_time"), of_engagement.alias("_e"))
    given = awards.select(F.col(key).alias("_key"), F.col(awarded).alias("_time"), of_award.alias("_a"))
    none = {"_e": asked.schema["_e"].dataType, "_a": given.schema["_a"].dataType}
    comparable = F.col("_key").isNotNull() & F.col("_time").isNotNull()
    rows = (
        asked.where(comparable).withColumn("_a", F.lit(None).cast(none["_a"]))
        .unionByName(given.where(comparable).withColumn("_e", F.lit(None).cast(none["_e"])))
        .withColumn("_span", F.date_trunc(span, "_time")))
    # an award comes after the engagements of its time, so those meet it first going back
    back = Window.partitionBy("_key", "_span").orderBy(F.desc("_time"), F.col("_a").isNull(), F.desc("_a")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("_next", F.last("_a", ignorenulls=True).over(back)).where(F.col("_e").isNotNull())
    later = Window.partitionBy("_key").orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_key", "_span").agg(F.min("_a").alias("_first")).select(
        "_key", "_span", F.last("_first", ignorenulls=True).over(later).alias("_carried"))
    paired = own.join(carried, ["_key", "_span"]).select("_e", F.coalesce("_next", "_carried").alias("_a"))
    rest = asked.where(~comparable).select("_e", F.lit(None).cast(none["_a"]).alias("_a"))
    return paired.unionByName(rest).select(
        "_e.*", F.col("_a._at").alias(awarded), F.col("_a._tie").alias(tie), *[F.col(f"_a._{k}").alias(c) for k, c in enumerate(keep)])


def engagement_award_totals(clients: DataFrame, awards: DataFrame, *, client: str,
                            recipient: str, amount: str, award: str, top: int = 5,
                            key=normalize_name) -> DataFrame:
    """Awards of each client by normalised name: number, sum and the largest few."""
    names = clients.select(key(client).alias("name_key"), client).where(
        F.col("name_key").isNotNull()).groupBy("name_key").agg(F.min(client).alias("client"))
    paid = awards.select(key(recipient).alias("name_key"), award, amount)
    sums = paid.groupBy("name_key").agg(
        F.count("*").alias("n_awards"), F.sum(amount).alias("total_amount"))
    best = (
        top_k_per_key(paid, "name_key", [*desc(amount), *asc(award)], top, "rank")
        .groupBy("name_key")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", award))),
                                      lambda s: s[award].cast("string")), ",").alias("top_awards"))
    )
    return (
        names.join(sums, "name_key", "left").join(best, "name_key", "left")
        .fillna(0, subset=["n_awards"]).fillna(0.0, subset=["total_amount"])
        .select("client", "n_awards", "total_amount", "top_awards")
    )


def top_countries(df: DataFrame, country: str, n: int = 15) -> DataFrame:
    """Most frequent countries."""
    return ranked(df.where(F.col(country).isNotNull()).groupBy(country)
                  .agg(F.count("*").alias("n")), [*desc("n"), *asc(country)], n)


def exact_copies(df: DataFrame, text: str, ident: str) -> DataFrame:
    """First row per distinct text, compared by digest so whole texts need not be shuffled."""
    return keep_first(
        df.select(ident, F.sha2(F.col(text), 256).alias("text_sha")), "text_sha", asc(ident))
