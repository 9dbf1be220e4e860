"""Column coercions used while loading raw records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE = r"^[+-]?\d+$"
OUTER_SPACE = r"(?U)^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_null(c) -> Column:
    """Trim all surrounding whitespace (tabs and newlines too); empty becomes null."""
    return F.nullif(F.regexp_replace(_col(c).cast("string"), OUTER_SPACE, ""), F.lit(""))


def to_double(c) -> Column:
    """Money text to double: drops ``$`` and ``,``; anything unreadable becomes null."""
    text = strip_null(F.regexp_replace(_col(c).cast("string"), "[$,]", ""))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_int(c) -> Column:
    """Whole-number text to int; ``1.0``, separators and overflow become null."""
    text = strip_null(c)
    return F.when(text.rlike(WHOLE), text.try_cast("int"))


def tri_bool(c) -> Column:
    """Null stays null, everything else is its truth value."""
    text = F.lower(_col(c).cast("string"))
    return F.when(text.isNotNull(), ~text.isin("false", "", "0", "0.0"))


def leading_int(c) -> Column:
    """The digits a composite id starts with (``40012-123`` gives 40012)."""
    digits = F.regexp_extract(_col(c).cast("string"), r"^(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def child_id(parent, position, tag: str = "a") -> Column:
    """Stable id of a nested child: parent id, ``::`` tag and its 0-based position."""
    return F.concat(_col(parent).cast("string"), F.lit(f"::{tag}"), _col(position).cast("string"))


def hash_id(c, length: int = 16) -> Column:
    """A short stable id: the first hex digits of the SHA-1 of the value."""
    return F.substring(F.sha1(_col(c).cast("string")), 1, length)


def first_non_empty(*cols, skip_zero: bool = False) -> Column:
    """First value that is neither null nor the empty string (optionally not 0 either)."""
    kept = []
    for c in cols:
        value = F.nullif(_col(c).cast("string"), F.lit(""))
        kept.append(F.nullif(value, F.lit("0")) if skip_zero else value)
    return F.coalesce(*kept)


def parsed_date(c, fmt: str | None = None) -> Column:
    """Date companion of a raw date string; unreadable text becomes null."""
    text = strip_null(c)
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text))
