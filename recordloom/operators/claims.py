"""Claims and what they rest on, as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import _col, strip_null
from ..functions.text import PHRASE_PATTERN, find_all

# Kinds of record cards, text that stands for what is held back.
CARD_NAME = r"^(senate_filing|house_filing|press_release)_(.+)\.md$"
REDACTED = "[REDACTED]"
REDACT_OVER = 200


def entity_mentions(claims: DataFrame, *, claim: str = "claim_id", statement: str = "statement",
                    pattern: str = PHRASE_PATTERN, group: int = 1, shortest: int = 4,
                    longest: int = 80) -> DataFrame:
    """Capitalised phrases of each statement, once each, with the order of first appearance."""
    return (
        claims.select(claim, F.posexplode(find_all(statement, pattern, group)).alias("pos", "e"))
        .select(claim, "pos", strip_null("e").alias("entity"))
        .where(F.length("entity").between(shortest, longest))
        .groupBy(claim, "entity").agg(F.min("pos").alias("first_pos"))
    )


def claim_edges(claims: DataFrame, *, claim: str = "claim_id", **mentions) -> DataFrame:
    """``(src, dst, kind)``: what each claim names and cites."""
    def cited(kind, values):
        return claims.select(F.col(claim).alias("src"), F.explode(values).alias("dst")).select(
            "src", "dst", F.lit(kind).alias("kind"))

    named = entity_mentions(claims, claim=claim, **mentions).select(
        F.col(claim).alias("src"), F.col("entity").alias("dst"), F.lit("entity").alias("kind"))
    return (
        named.unionByName(cited("card", F.col("supporting_cards")))
        .unionByName(cited("query", F.col("supporting_query_hashes")))
        .unionByName(cited("url", F.transform("external_sources", lambda s: s["url"])))
        .where(F.col("dst").isNotNull()).distinct()
    )


def node_degrees(edges: DataFrame) -> DataFrame:
    """Cited nodes with the number of claims behind them."""
    return edges.groupBy("kind", "dst").agg(F.count("*").alias("n_claims"))


def redact(claims: DataFrame, *, statement: str = "statement") -> DataFrame:
    """Claims without long statements and without the addresses of external sources."""
    hidden = F.when(F.length(statement) > REDACT_OVER, REDACTED).otherwise(F.col(statement))
    out = claims.withColumn(statement, hidden)
    if "external_sources" in claims.columns:
        out = out.withColumn("external_sources", F.transform(
            "external_sources", lambda s: s.withField("url", F.lit(REDACTED))))
    return out


def redact_entities(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("entity", F.lit(REDACTED))


def card_kind(c) -> Column:
    """Kind part of a card file name; null if it is none."""
    return F.nullif(F.regexp_extract(_col(c), CARD_NAME, 1), F.lit(""))


def card_record(c) -> Column:
    """Record id of a card file name; null if it is none."""
    return F.nullif(F.regexp_extract(_col(c), CARD_NAME, 2), F.lit(""))


def summary_counts(claims: DataFrame) -> DataFrame:
    """Claims by confidence and verdict."""
    return claims.groupBy(
        F.coalesce("confidence", F.lit("?")).alias("confidence"),
        F.coalesce("fact_check_status", F.lit("?")).alias("verdict")
    ).agg(F.count("*").alias("n_claims"))
