"""Small expressions that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.session import cut_lineage

# White space is the blank and U+0009 to U+000D, a word is a run of anything else.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_of(column: str | Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def total(numbers: Column, zero=0) -> Column:
    """Sum of an array."""
    start = F.lit(zero).cast("long")
    return F.aggregate(numbers, start, lambda a, x: a + x)


def keyed_by_text(docs: DataFrame, text: str = "text") -> list[Column]:
    """Two longs that name a text; copies of a text share them."""
    t = text_of(text)
    return [F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2")]


def private(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as make them differ from all columns (case aside)."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def numbered(columns: list[str]) -> list[Column]:
    """The columns under the names ``c0``, ``c1`` and so on, which no helper column has."""
    return [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]


def renamed(columns: list[str]) -> list[Column]:
    """Back from ``numbered``."""
    return [F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]


def md5_number(text: Column) -> Column:
    """60 bits of the text's MD5, a number that other engines compute alike."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shipped_if_small(side: DataFrame, most_rows: int) -> DataFrame:
    """The staged side of a join, to be broadcast if its counted rows are within the bound; with more
    rows the planner shuffles both sides, with equal results."""
    side = cut_lineage(side)
    return F.broadcast(side) if side.count() <= most_rows else side
