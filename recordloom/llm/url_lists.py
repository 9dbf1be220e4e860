"""Dated URL lists, joined as of the time of each capture.

A list is a log of dated entries (``add`` or ``remove``) for a domain (with all below it), a host, or a URL prefix.
Entries of one value, in order of date, become validity intervals: from an ``add`` up to the next entry. A
capture is blocked by every entry active when it was fetched.

A URL is looked up under its host, the host's parent domains and its path's prefixes, an equi-join on
kind and value. The time goes into the join key too: intervals are laid out over the months they
cover, a capture has one month, so a value with a long history and many captures meets only the few
intervals of the month, and exact dates are compared last. Equal captures (URL and time) are judged once,
matches are combined with partial aggregates, and a host with a third of all captures is a skewed join
key that the planner can split.

Edge cases: a null or unparsable URL and a null fetch time match nothing; entries with a null value, date or
action are ignored; of several entries for one value and date a ``remove`` wins; repeated rows get the same
verdict each; an empty side gives unblocked captures or an empty result. Input columns named like a result
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.llm.common import numbered, renamed
from recordloom.session import cut_lineage

RESULT = ("host", "blocked", "rule", "listed_from", "n_active")


def host_of(url: Column) -> Column:
    """The host in lower case, or null."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)", 1)
    return F.when(host != "", F.rtrim(F.lower(host), F.lit(".")))


def path_of(url: Column) -> Column:
    """The path, ``/`` at least."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def lookups(url: Column) -> Column:
    """All ``kind:value`` keys under which an entry can name the URL."""
    host, path = host_of(url), path_of(url)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    # "/a/b" has the prefixes "/", "/a/" and itself
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(
        F.lit("prefix:"), host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("host:"), host)), domains, prefixes, F.array(F.concat(F.lit("prefix:"), host, path))))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, valid_from, valid_to`` (exclusive, null: still valid) from ``kind, value, dated, action``."""
    clean = entries.where(F.col("kind").isNotNull() & F.col("value").isNotNull() & F.col("dated").isNotNull()
                          & F.col("action").isin("add", "remove"))
    # the host in lower case; a path keeps its case, as in the captures
    host = F.substring_index("value", "/", 1)
    value = F.concat(F.lower(host), F.expr("substring(value, length(substring_index(value, '/', 1)) + 1)"))
    daily = clean.groupBy(F.concat_ws(":", F.col("kind"), value).alias("key"), "dated").agg(
        F.max("action").alias("action"))  # "remove" is the greater
    ahead = F.lead("dated").over(Window.partitionBy("key").orderBy("dated"))
    return daily.withColumn("valid_to", ahead).where(F.col("action") == "add").select(
        "key", F.col("dated").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on",
          columns: list[str] | None = None) -> DataFrame:
    """The captures with ``host``, ``blocked``, the most specific active ``rule`` (``kind:value``: the longest
    prefix before the host before the longest domain), the date it is ``listed_from``, and ``n_active``.

    ``columns``: the input columns to carry (all).
    """
    asked = cut_lineage(
        captures.select(F.col(url).alias("_url"), F.col(fetched).alias("_at"))
        .where(host_of(F.col("_url")).isNotNull() & F.col("_at").isNotNull()).distinct())
    last = asked.agg(F.max("_at").alias("x")).scalar()
    month = lambda c: F.trunc(c, "MM")
    spans = cut_lineage(
        intervals(entries).withColumn("_last", last)
        .where(F.col("valid_from") <= F.col("_last"))
        .select("key", "valid_from", "valid_to", F.explode(F.sequence(
            month(F.col("valid_from")), month(F.least("valid_to", "_last")), F.expr("interval 1 month"))).alias("month")))
    keys = asked.select("_url", "_at", F.explode(lookups(F.col("_url"))).alias("key"), month(F.col("_at")).alias("month"))
    place = (F.when(F.col("key").startswith("prefix:"), 3).when(F.col("key").startswith("host:"), 2).otherwise(1))
    active = (
        keys.join(spans, ["key", "month"])
        .where((F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
        .groupBy("_url", "_at").agg(
            F.max(F.struct(place.alias("p"), F.length("key").alias("n"), "key", "valid_from")).alias("_top"),
            F.count("*").alias("_n"))
    )
    active = cut_lineage(active).withColumnsRenamed({"_url": "_u2", "_at": "_t2"})
    carried = [c for c in (captures.columns if columns is None else columns) if c not in RESULT]
    rows = captures.select(*numbered(carried), F.col(url).alias("_url"), F.col(fetched).alias("_at"))
    joined = rows.join(active, (F.col("_url") == F.col("_u2")) & (F.col("_at") == F.col("_t2")), "left")
    return joined.select(
        *renamed(carried), host_of(F.col("_url")).alias("host"), F.col("_top").isNotNull().alias("blocked"),
        F.col("_top.key").alias("rule"), F.col("_top.valid_from").alias("listed_from"),
        F.coalesce("_n", F.lit(0)).alias("n_active"))
