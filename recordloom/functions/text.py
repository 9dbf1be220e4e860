"""Keyword signals and pattern extraction over free text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .coerce import _col

# Legislative bill citations, e.g. "H.R. 5376", "S. 2587", "H.J.Res. 7".
BILL_PATTERN = r"(?i)\b(?:H\.?\s?J\.?\s?RES\.?|S\.?\s?J\.?\s?RES\.?|H\.?\s?R\.?|S\.?)\s?\d{1,5}\b"
# Citation tokens, i.e. UUIDs and absolute URLs.
CITATION_PATTERN = (
    r"""[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}|https?://[^\s)"]+"""
)
RECORD_ID_PATTERN = r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
URL_PATTERN = r"""https?://[^\s)"]+"""
# Capitalised phrases taken as entity mentions.
PHRASE_PATTERN = (
    r"\b([A-Z][A-Za-z0-9&'.\-]+(?:\s+(?:and|&|of|for|the)?\s*[A-Z][A-Za-z0-9&'.\-]+){0,5})\b"
)


def any_keyword(c, keywords, word: bool = False) -> Column:
    """True where the case-folded text holds any keyword; null text is false.

    All keywords share one alternation, so the text is scanned once. ``word``
    asks for whole words instead of substrings.
    """
    if len(keywords) == 1 and not word:
        return contains_folded(c, keywords[0])
    pattern = "|".join(re.escape(k.lower()) for k in keywords)
    if word:
        pattern = rf"\b({pattern})\b"
    return F.lower(F.coalesce(_col(c), F.lit(""))).rlike(pattern)


def contains_folded(c, part) -> Column:
    """Case-folded substring test that is false on null text."""
    return F.contains(F.lower(F.coalesce(_col(c), F.lit(""))), F.lower(F.lit(part)))


def first_label(c, labels) -> Column:
    """First label, in the given order, one of whose keywords occurs in the text."""
    out = None
    for label, keywords in labels:
        hit = any_keyword(c, keywords)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def find_all(c, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, left to right."""
    return F.regexp_extract_all(_col(c), F.lit(pattern), group)


def bill_key(c) -> Column:
    """Bill citation without dots and spaces, upper-cased (``H.R. 5376`` gives ``HR5376``)."""
    return F.upper(F.regexp_replace(_col(c), r"[.\s]", ""))
