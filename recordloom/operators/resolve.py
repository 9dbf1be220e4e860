"""Resolving the same organisation across two registries, in three passes.

Pass 1 joins on a bridge key, pass 2 on equal normalised names, pass 3 on
similar names. Each pass works on what the passes before left over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fuzzy import token_set_scorer
from ..functions.names import normalize_name
from ..session import cut_lineage
from .shape import asc, desc, top_k_per_key


def entity_pool(df: DataFrame, *, ident: str, name: str, extra=(), need: str | None = None
                ) -> DataFrame:
    """Distinct entities of a registry with their normalised name."""
    return (
        df.where(F.col(need or ident).isNotNull()).select(ident, name, *extra).distinct()
        .withColumn("norm_name", normalize_name(name))
    )


def bridge_pass(left: DataFrame, right: DataFrame, bridges, *, ident: str, name: str,
                right_name: str) -> DataFrame:
    """Pairs tied by a bridge key. ``bridges`` lists (left column, right column, label)."""
    out = None
    for a, b, label in bridges:
        l = left.where(F.col(a).isNotNull()).select(
            F.col(a).alias("_k"), F.col(ident).alias("left_id"), F.col(name).alias("left_name"))
        r = right.where(F.col(b).isNotNull()).select(
            F.col(b).alias("_k"), F.col(right_name).alias("right_name")).distinct()
        # both registries grow with the input: sorted and merged, whatever the planner takes their size to be
        pairs = l.join(r.hint("merge"), "_k").select(
            "left_id", "left_name", "right_name", F.lit(label).alias("resolution_pass"))
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def exact_pass(left: DataFrame, right: DataFrame, done: DataFrame, *, ident: str, name: str,
               right_name: str, same=()) -> DataFrame:
    """Pairs with equal normalised name among ids not matched yet.

    ``same`` lists (left column, right column) pairs that must agree as well.
    """
    l = left.where(F.col("norm_name").isNotNull()).select(
        "norm_name", F.col(ident).alias("left_id"), F.col(name).alias("left_name"),
        *[F.col(a).alias(f"_s{i}") for i, (a, _) in enumerate(same)])
    r = right.where(F.col("norm_name").isNotNull()).select(
        "norm_name", F.col(right_name).alias("right_name"),
        *[F.col(b).alias(f"_s{i}") for i, (_, b) in enumerate(same)]).distinct()
    keys = ["norm_name", *[f"_s{i}" for i in range(len(same))]]
    return (
        # as in the bridge pass, nothing here is short enough for the driver at every size
        l.join(done.select("left_id").hint("merge"), "left_id", "left_anti").join(r.hint("merge"), keys)
        .select("left_id", "left_name", "right_name",
                F.lit("exact_normalized").alias("resolution_pass"))
        .distinct()
    )


def residual(left: DataFrame, matched: list[DataFrame], *, ident: str, name: str,
             limit: int | None = None) -> DataFrame:
    """Entities with a normalised name that no earlier pass matched."""
    out = left.where(F.col("norm_name").isNotNull()).select(
        F.col(ident).alias("left_id"), F.col(name).alias("left_name"), "norm_name").distinct()
    for pairs in matched:
        out = out.join(pairs.select("left_id").hint("merge"), "left_id", "left_anti")
    return out if limit is None else out.orderBy("left_id", "left_name").limit(limit)


# --- candidates of pass 3 ---------------------------------------------------------

def _tokens(c):
    return F.array_distinct(F.split(c, " "))


def _weighted_prefix(words: DataFrame, share: float) -> DataFrame:
    """The rarest words of each name that together weigh more than ``share`` of it."""
    df = words.groupBy("token").agg(F.count("*").alias("n"))
    packed = words.join(df, "token").groupBy("name", "l", "r").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ts"))

    def weight(ts):
        return F.aggregate(ts, F.lit(0), lambda a, t: a + F.length(t["token"]) + 1)

    # a word is kept while the rarer words before it weigh at most the share
    kept = F.filter("ts", lambda t, i: weight(F.slice("ts", F.lit(1), i))
                    <= weight(F.col("ts")) * F.lit(share))
    return packed.select("name", "l", "r", F.explode(kept).alias("t")).select(
        "name", "l", "r", "t.token")


def _grams(c, q: int):
    """Windows of ``q`` letters of every token padded with ``_``, numbered when they repeat."""
    tokens = F.transform(_tokens(c), lambda t: F.concat(F.lit("_"), t, F.lit("_")))
    raw = F.flatten(F.transform(tokens, lambda t: F.transform(
        F.sequence(F.lit(1), F.length(t) - (q - 1)), lambda i: F.substring(t, i, q))))
    return F.transform(raw, lambda g, i: F.struct(
        g.alias("g"), F.size(F.filter(F.slice(raw, F.lit(1), i), lambda h: h == g)).alias("k")))


def _gram_prefix(names: DataFrame, t: float, q: int, need: int) -> DataFrame:
    """The rarest windows of each name of which every close enough name holds ``need``.

    Two names of lengths a and b whose edit similarity reaches t have a common
    subsequence of at least ``t * (a + b) / 2`` letters. A letter outside it spoils
    at most q windows of its own name and q - 1 of the other. Windows do not cross
    words, so the order of words does not matter. That leaves at least

    * q = 3: ``(2.5 * t - 2) * (a + b) - (words - 1)``
    * q = 2: ``(1.5 * t - 1) * (a + b) + 1``

    shared windows. If two sets share s or more elements, the first ``size - s + need``
    elements of each, in one common order, share ``need`` (at most s) of them. Rare
    windows come first in that order. ``need`` is smaller where s is.
    """
    words = _tokens("name")
    length = F.length(F.array_join(words, " "))
    # the shortest name that can still be close enough
    partner = F.ceil(length * F.lit(t / (2 - t)) - 1e-9)
    if q == 3:
        shared = F.lit(2.5 * t - 2) * (length + partner) - (F.size(words) - 1)
    else:
        shared = F.lit(1.5 * t - 1) * (length + partner) + 1
    grams = names.select("name", "l", "r", F.explode(_grams("name", q)).alias("gk")).select(
        "name", "l", "r", "gk.g", "gk.k")
    df = grams.groupBy("g", "k").agg(F.count("*").alias("n"))
    packed = grams.join(df, ["g", "k"]).groupBy("name", "l", "r").agg(
        F.array_sort(F.collect_list(F.struct("n", "g", "k"))).alias("gs"))
    bound = F.greatest(F.ceil(shared - 1e-9), F.lit(1)).cast("int")
    wanted = F.least(bound, F.lit(need))
    kept = F.slice("gs", F.lit(1), F.size("gs") - bound + wanted)
    return packed.select(
        "name", "l", "r", length.alias("len"), wanted.alias("need"), F.explode(kept).alias("e")
    ).select("name", "l", "r", "len", "need", "e.g", "e.k")


def similar_name_candidates(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Pairs of distinct names that can reach ``floor`` (0..100) in the token-set score.

    No pair is lost. The score reaches the floor in one of two ways:

    * the shared words make up nearly all of one name. What is left outside weighs
      at most a small share of the name, so among its rarest words that weigh more
      than that share at least one is a shared word;
    * both names are close as strings, which ``_gram_prefix`` covers.

    Joining on the rarest words and windows keeps the groups small: a word that a
    third of all names hold is only joined for names made of such words alone.
    """
    t = floor / 100.0
    if t <= 0.7:
        raise ValueError("below 70 the bound on shared windows holds no information")
    # windows of three always leave something shared from 10/11 on
    q = 3 if t >= 10 / 11 else 2
    names = cut_lineage(
        left.select(F.col("norm_name").alias("name"), F.lit(True).alias("l"), F.lit(False).alias("r"))
        .union(right.select("norm_name", F.lit(False), F.lit(True)))
        .groupBy("name").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r")))

    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(x, y, keys):
        # few bytes turn into many pairs here, so the input is spread over all tasks
        return x.where("l").drop("l", "r").withColumnsRenamed(
            {"name": "left_norm", "len": "len_l", "need": "need_l"}).repartition(tasks).join(
            y.where("r").drop("l", "r").withColumnsRenamed(
                {"name": "right_norm", "len": "len_r", "need": "need_r"}), keys)

    # 2 * shared / (2 * shared + 1 + rest) >= t, turned into a share of the whole name
    slack = 2.0 / t - 2.0
    words = names.select("name", "l", "r", F.explode(_tokens("name")).alias("token"))
    rare_words = cut_lineage(_weighted_prefix(words, slack / (1.0 + slack)))
    rare_grams = cut_lineage(_gram_prefix(names, t, q, need=3))
    low = F.lit(t / (2 - t))
    close = ((F.col("len_l") >= F.col("len_r") * low - 1e-9)
             & (F.col("len_r") >= F.col("len_l") * low - 1e-9))
    by_gram = (
        pairs(rare_grams, rare_grams, ["g", "k"]).where(close)
        .groupBy("left_norm", "right_norm")
        .agg(F.count("*").alias("n"), F.min(F.least("need_l", "need_r")).alias("need"))
        .where(F.col("n") >= F.col("need")))
    out = None
    for found in (pairs(rare_words, words, "token"), pairs(words, rare_words, "token"), by_gram):
        found = found.select("left_norm", "right_norm")
        out = found if out is None else out.union(found)
    return out.distinct()


def fuzzy_pass(rest: DataFrame, right: DataFrame, *, right_name: str, threshold: float = 92,
               margin: float = 2, review_floor: float | None = None, shown: int = 3):
    """Best similar names for the residual: (accepted pairs, queue for review).

    The best candidate at or above the threshold is accepted unless a second one
    is within ``margin`` of it and reaches the threshold too; such entities go to
    the queue with their best candidates. The same normalised name held by two
    organisations counts as two candidates. ``review_floor`` lets the queue show
    candidates below the threshold as well.
    """
    floor = threshold if review_floor is None else min(review_floor, threshold)
    pool = right.where(F.col("norm_name").isNotNull()).select(
        F.col("norm_name").alias("right_norm"), F.col(right_name).alias("right_name")).distinct()
    # of organisations that share a name only the first few can ever be shown
    pool = top_k_per_key(pool, "right_norm", asc("right_name"), shown)
    score = token_set_scorer()
    rest = cut_lineage(rest)
    scored = (
        similar_name_candidates(rest, right.where(F.col("norm_name").isNotNull()), floor)
        .withColumn("score", score("left_norm", "right_norm"))
        .where(F.col("score") >= floor)
    )
    # names first, then the organisations behind the best names only
    scored = top_k_per_key(scored, "left_norm", [*desc("score"), *asc("right_norm")], shown)
    best = top_k_per_key(
        scored.join(pool, "right_norm"), "left_norm",
        [*desc("score"), *asc("right_norm", "right_name")], shown, "rank")
    packed = best.groupBy("left_norm").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "right_norm", "right_name")))
        .alias("c"))
    first, second = F.col("c")[0], F.get("c", F.lit(1))
    judged = (
        packed.where(first["score"] >= threshold)
        .withColumn("ambiguous", F.coalesce(
            (second["score"] >= first["score"] - margin) & (second["score"] >= threshold),
            F.lit(False)))
        .withColumnRenamed("left_norm", "norm_name")
    )
    out = cut_lineage(rest.join(judged, "norm_name"))  # scored once for both results
    accepted = out.where(~F.col("ambiguous")).select(
        "left_id", "left_name", F.col("c")[0]["right_name"].alias("right_name"),
        F.lit("fuzzy").alias("resolution_pass"), F.col("c")[0]["score"].alias("score"))
    queue = out.where("ambiguous").select(
        "left_id", "left_name",
        F.array_join(F.transform("c", lambda x: x["right_norm"]), " | ").alias("candidates"),
        F.array_join(F.transform("c", lambda x: F.round(x["score"], 4).cast("string")), ",")
        .alias("scores"))
    return accepted, queue


def consolidate(passes: list[DataFrame]) -> DataFrame:
    """All passes in one table; score is null where a pass has none."""
    out = None
    for p in passes:
        if "score" not in p.columns:
            p = p.withColumn("score", F.lit(None).cast("double"))
        out = p if out is None else out.unionByName(p)
    return out


def attach_canonical(records: DataFrame, canonical: DataFrame, *, ident: str,
                     alias: str = "canonical_name") -> DataFrame:
    """Records with the name their entity resolved to; null where it did not."""
    names = canonical.groupBy(F.col("left_id").alias(ident)).agg(
        F.min("right_name").alias(alias))
    return records.join(names, ident, "left")


def resolution_report(canonical: DataFrame, left: DataFrame, right: DataFrame, queue: DataFrame,
                      *, ident: str, right_name: str) -> DataFrame:
    """Counts per pass, pool sizes, matched share and queue size as (metric, value) rows."""
    def rows(df, metric, value):
        return df.select(metric.alias("metric"), value.cast("double").alias("value"))

    per_pass = canonical.groupBy("resolution_pass").agg(F.count("*").alias("n"))
    n_left = left.agg(F.count_distinct(ident).alias("n"))
    n_right = right.agg(F.count_distinct(right_name).alias("n"))
    matched = canonical.agg(F.count_distinct("left_id").alias("n"))
    share = matched.select(F.col("n").alias("m"), n_left.scalar().alias("t")).select(
        F.when(F.col("t") > 0, F.round(F.lit(100.0) * F.col("m") / F.col("t"), 1)).alias("n"))
    return (
        rows(per_pass, F.concat(F.lit("pass:"), "resolution_pass"), F.col("n"))
        .unionByName(rows(n_left, F.lit("left_entities"), F.col("n")))
        .unionByName(rows(n_right, F.lit("right_entities"), F.col("n")))
        .unionByName(rows(matched, F.lit("matched_entities"), F.col("n")))
        .unionByName(rows(share, F.lit("matched_pct"), F.col("n")))
        .unionByName(rows(queue.agg(F.count("*").alias("n")), F.lit("ambiguous"), F.col("n")))
    )
