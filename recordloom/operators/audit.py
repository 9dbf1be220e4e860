"""Checks that every number and citation can be traced and repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import CITATION_PATTERN, RECORD_ID_PATTERN, URL_PATTERN, find_all
from ..session import cut_lineage
from .shape import as_list

# Which claims have to be in the evidence map, and card-less claims are not allowed.
SURE = ("high", "medium")
CONFIRMED = ("verified", "partially_verified")


def row_hash(df: DataFrame) -> Column:
    """60 bits of the MD5 of a row's values as text, in the order of the column names."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in sorted(df.columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells)), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive digest of a table, in one row.

    Row hashes are added up in a wide decimal, so equal rows do not cancel out.
    """
    return df.agg(F.count("*").alias("row_count"),
                  F.coalesce(F.sum(row_hash(df)), F.lit(0).cast("decimal(38,0)")).cast("string")
                  .alias("digest"))


def replay_check(cited: DataFrame, provenance: DataFrame, replayed: DataFrame) -> DataFrame:
    """Status of every cited query hash.

    ``provenance`` holds ``(sql_hash, row_count, digest)`` as recorded,
    ``replayed`` the same after running the queries again.
    """
    old = provenance.groupBy("sql_hash").agg(
        F.min("row_count").alias("_n"), F.min("digest").alias("_d"))
    new = replayed.groupBy("sql_hash").agg(
        F.min("row_count").alias("_m"), F.min("digest").alias("_e"))
    status = (
        F.when(F.col("_n").isNull(), "provenance missing")
        .when(F.col("_m").isNull(), "not replayed")
        .when(F.col("_n") != F.col("_m"), "row count differs")
        .when(~F.col("_d").eqNullSafe(F.col("_e")), "values differ")
        .otherwise("match"))
    return (
        cited.select("sql_hash").distinct().join(old, "sql_hash", "left")
        .join(new, "sql_hash", "left")
        .select("sql_hash", F.col("_n").alias("recorded_rows"), F.col("_m").alias("replayed_rows"),
                status.alias("status"))
    )


def ledger_integrity(findings: DataFrame, evidence: DataFrame, cards: DataFrame,
                     provenance: DataFrame) -> DataFrame:
    """Broken rules of an evidence map as ``(rule, claim_id, detail)``.

    ``findings`` and ``evidence`` are claim tables, ``cards`` holds ``card`` file
    names and ``provenance`` the ``sql_hash`` of recorded queries.
    """
    def broken(df, rule, detail=None):
        return df.select(F.lit(rule).alias("rule"), "claim_id",
                         (F.lit(None) if detail is None else F.col(detail)).cast("string")
                         .alias("detail"))

    due = findings.where(F.col("confidence").isin(*SURE) & F.col("fact_check_status").isin(*CONFIRMED))
    cited_cards = evidence.select("claim_id", F.explode("supporting_cards").alias("card"))
    cited_hashes = evidence.select("claim_id",
                                   F.explode("supporting_query_hashes").alias("sql_hash"))
    twice = evidence.groupBy("claim_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)

    def rule(name, detail=None):
        return F.struct(F.lit(name).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))

    # the rules that a claim breaks by itself, in one scan
    loose = F.filter(F.coalesce("external_sources", F.array().cast(dict(evidence.dtypes)["external_sources"])),
                     lambda s: F.nullif(s["archive_path"], F.lit("")).isNull())
    own = evidence.select("claim_id", F.inline(F.concat(
        F.array_compact(F.array(
            F.when(F.size(F.coalesce("supporting_cards", F.array())) == 0, rule("no cards")),
            F.when(~F.col("claim_id").rlike(r"^C-\d+$"), rule("claim id malformed")))),
        F.transform(loose, lambda s: rule("external source not archived", s["url"]))))).select("rule", "claim_id", "detail")
    return (
        broken(due.join(evidence.select("claim_id"), "claim_id", "left_anti"), "not in map")
        .unionByName(own)
        .unionByName(broken(cited_cards.join(cards.select("card"), "card", "left_anti"),
                            "card missing", "card"))
        .unionByName(broken(cited_hashes.join(provenance.select("sql_hash"), "sql_hash",
                                              "left_anti"), "provenance missing", "sql_hash"))
        .unionByName(broken(twice, "claim id not unique", "n"))
    )


def citation_tokens(texts: DataFrame, text: str, pattern: str = CITATION_PATTERN,
                    group: int = 0) -> DataFrame:
    """Distinct citation tokens of all texts."""
    return texts.select(F.explode(find_all(text, pattern, group)).alias("token")).distinct()


def citation_closure(outputs: DataFrame, truth: DataFrame, text: str = "text",
                     pattern: str = CITATION_PATTERN, group: int = 0) -> DataFrame:
    """Tokens cited in outputs that no ground-truth text holds as a token."""
    return citation_tokens(outputs, text, pattern, group).join(
        citation_tokens(truth, text, pattern, group), "token", "left_anti")


def citation_closure_text(outputs: DataFrame, truth: DataFrame, text: str = "text") -> DataFrame:
    """Ids and URLs cited in outputs that stand nowhere in a ground-truth text, as parts of longer ones either.

    An id is looked for everywhere, inside URLs too. A URL is part of a text if and only if a URL of the text,
    read from one of its ``http`` on, begins with it: those are cut to the lengths that cited URLs have, so
    all of it is joins on equal tokens.
    """
    ids = citation_tokens(outputs, text, RECORD_ID_PATTERN).join(
        citation_tokens(truth, text, RECORD_ID_PATTERN), "token", "left_anti")
    # an id that is only part of a cited URL is not cited by itself
    alone = outputs.select(F.regexp_replace(text, URL_PATTERN, " ").alias(text))
    ids = ids.join(citation_tokens(alone, text, RECORD_ID_PATTERN), "token", "left_semi")
    cited = cut_lineage(citation_tokens(outputs, text, URL_PATTERN))
    lengths = cited.agg(F.collect_set(F.length("token")).alias("n")).scalar()
    whole = truth.select(F.explode(find_all(text, URL_PATTERN, 0)).alias("url"))
    starts = whole.select(F.explode(F.filter(
        F.transform(F.sequence(F.lit(1), F.length("url")), lambda i: F.when(
            F.substring(F.col("url"), i, 8).rlike("^https?://"), F.substring(F.col("url"), i, F.length("url")))),
        lambda u: u.isNotNull())).alias("url")).distinct()
    known = starts.withColumn("_n", lengths).select(F.explode(F.transform(
        F.filter("_n", lambda n: n <= F.length("url")), lambda n: F.substring(F.col("url"), F.lit(1), n))).alias("token"))
    return ids.unionByName(cited.join(known.distinct(), "token", "left_anti"))


def vintage_diff(old: DataFrame, new: DataFrame, keys, value: str) -> DataFrame:
    """Keyed totals of two pulls of the same query side by side, with what changed."""
    keys = as_list(keys)
    both = (
        old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("_o"))
        .join(new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("_n")), keys,
              "full_outer"))
    change = (
        F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("changed"))
    return both.select(*keys, "old_value", "new_value", change.alias("change"))


def supersession_history(versions: DataFrame, claim: str, recorded: str) -> DataFrame:
    """Versions with the time until which each held; the latest one is current.

    Only the distinct times of a claim are put in order, not its rows.
    """
    w = Window.partitionBy(claim).orderBy(recorded)
    times = versions.select(claim, recorded).distinct().withColumn(
        "valid_to", F.lead(recorded).over(w))
    return versions.join(times, [claim, recorded]).withColumn(
        "is_current", F.col("valid_to").isNull())
