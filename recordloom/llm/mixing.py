"""Mix sources to target weights, cut to the word.

Every document gets a hash-random key, made of its id and its text, so that rows which share a null or
repeated id are apart. Keys are uniform, so equal ranges of them
(``RANGES``) sort each source into pieces of equal expected size without a sample;
sums of the sizes per source and range, then prefix sums over the ranges, show in which
range the source's budget ends. Only the documents of that one range are sorted by
key and summed one by one. A budget beyond the source's size repeats it: whole
epochs first, the rest is cut. The document at the cut gives the words that are missing.

Sums are combined map-side, no text is moved, the prefix sums see at most ``RANGES``
rows per source, and the sorted piece is a ``RANGES``-th of its source. Results
depend on the rows only, not on how they are partitioned.

Edge cases: a null text has size 0 and takes 0; a null source is a source of its own, last in
order; rows of equal id and text have equal keys
and are interchangeable; a source without words has target 0; an empty table gives an empty result.
Input columns with the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.llm.common import md5_number, numbered, renamed, text_of
from recordloom.session import cut_lineage

RANGES = 4096
RESULT = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``_source, source_size, target`` from one row per source (``_source, source_size``).

    Weights go to the sources in code point order, null last, and repeat. The sources share
    ``share`` times all words by weight; a target stops at ``most`` times its source's size and the
    excess is shared by the others. That fills up to one level: with the sources in order of
    size per weight, the first ones are at their limit and the others have one rate per weight.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), place)
    filled = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("_source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(1))
    rate = (
        # the rate if this source and all before it in the order are at their limit
        (F.col("_all") * share - F.col("_at_limit")) / (F.col("_weights") - F.col("_weight_before"))
    )
    return (
        sizes.withColumn("_weight", w)
        .withColumns({
            "_all": F.sum("source_size").over(every), "_weights": F.sum("_weight").over(every),
            "_at_limit": most * (F.sum("source_size").over(filled) - F.col("source_size")),
            "_weight_before": F.sum("_weight").over(filled) - F.col("_weight"),
        })
        .withColumn("_rate", rate)
        # the first source in order whose limit is not reached sets the rate for the rest; of equal ones the
        # first has the highest rate
        .withColumn("_level", F.min(F.when(most * F.col("source_size") > F.col("_rate") * F.col("_weight"),
                                           F.struct(F.col("source_size") / F.col("_weight"), (-F.col("_rate")).alias("r")))
                                    ).over(every)["r"])
        .withColumn("_level", -F.col("_level"))
        .select("_source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(
            most * F.col("source_size").cast("double"),
            F.coalesce(F.col("_level") * F.col("_weight"), most * F.col("source_size").cast("double"))
        )).alias("target"))
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        source: str = "source", text: str = "text", doc_id: str = "doc_id",
        columns: list[str] | None = None) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``taken`` words.

    ``columns``: the input columns to carry (all).
    """
    key = md5_number(F.concat(F.lit("mix"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text))))
    # the upper 12 of the key's 60 bits, in its order
    place = F.shiftright(key, 48).cast("int")
    carried = [c for c in (docs.columns if columns is None else columns) if c not in RESULT]
    rows = docs.select(*numbered(carried), F.col(source).alias("_source"), F.col(doc_id).alias("_id"),
                       word_count(text_of(text)).alias("size"), key.alias("_key"), place.alias("_range"))
    sums = cut_lineage(rows.groupBy("_source", "_range").agg(F.sum("size").alias("_size")))
    plan = targets(sums.groupBy("_source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(budget / F.col("source_size"))).cast("long")
    plan = plan.withColumn("_epochs", epochs).withColumn(
        "_rest", (budget - F.col("_epochs") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    # the range in which the rest ends
    s = starts.withColumnRenamed("_source", "_s2")
    cut = (
        plan.join(s, plan["_source"].eqNullSafe(s["_s2"]) & (s["_before"] < plan["_rest"]), "left")
        .groupBy("_source", "source_size", "target", "_epochs", "_rest")
        .agg(F.max(F.struct("_range", "_before")).alias("_cut"))
        .select(F.col("_source").alias("_s"), "source_size", "target", "_epochs", "_rest",
                F.coalesce("_cut._range", F.lit(-1)).alias("_cut"),
                F.coalesce("_cut._before", F.lit(0)).alias("_start"))
    )
    cut = cut_lineage(cut)
    planned = rows.join(cut, rows["_source"].eqNullSafe(cut["_s"]))
    # only the rows of the cut ranges are summed one by one; the others know their answer
    inside = (
        planned.where(F.col("_range") == F.col("_cut"))
        .withColumn("_end", F.col("_start") + F.sum("size").over(
            Window.partitionBy("_source").orderBy("_key", F.col("_id").asc_nulls_last(), "size")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("taken", F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(
            F.col("size"), F.col("_rest") - (F.col("_end") - F.col("size")))))
    )
    whole = planned.where(F.col("_range") != F.col("_cut")).withColumn(
        "taken", F.col("_epochs") * F.col("size")
        + F.when(F.col("_range") < F.col("_cut"), F.col("size")).otherwise(0))
    out = [*renamed(carried), "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return whole.select(*out).unionByName(inside.select(*out))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document once for every epoch that takes words of it; the columns of ``docs``."""
    columns = docs.columns
    inputs = {name: options.pop(name, name) for name in ("source", "text", "doc_id")}
    places = {name: f"c{columns.index(c)}" for name, c in inputs.items()}
    # under other names, so that input columns named like a result come through as they are
    taken = mix(docs.select(*numbered(columns)), **places, **options)
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return taken.where(F.col("taken") > 0).select(
        *[F.col(f"c{k}") for k in range(len(columns))], F.explode(F.sequence(F.lit(1), times))).select(*renamed(columns))
