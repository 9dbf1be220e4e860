"""Name keys for matching organisations across registries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .coerce import _col

# Incorporation words dropped from a name before comparing it.
NAME_SUFFIXES = (
    "LLC", "LLP", "LP", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY",
    "PLLC", "PA", "CONSULTING", "GROUP", "PARTNERS", "HOLDINGS", "GMBH", "AG", "SA", "SARL",
    "LIMITED", "LTD", "PLC", "PTY", "NV", "BV",
)
# Punctuation that separates words in a name.
NAME_PUNCTUATION = r"""[.,'"()&]+"""
# Endings that mark a company registered abroad.
FOREIGN_SUFFIXES = ("Pty", "GmbH", "SA", "AG")


def normalize_name(c, suffixes=NAME_SUFFIXES) -> Column:
    """Upper-cased name without punctuation and incorporation words; empty becomes null."""
    name = F.regexp_replace(F.upper(_col(c)), NAME_PUNCTUATION, " ")
    name = F.regexp_replace(name, r"(?U)\b(" + "|".join(suffixes) + r")\b", " ")
    name = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    return F.nullif(name, F.lit(""))


def name_key_simple(c, compat: bool = False) -> Column:
    """Upper-cased name with everything but letters, digits and spaces blanked out.

    ``compat`` strips before upper-casing, which blanks every lower-case letter.
    """
    text = F.coalesce(_col(c), F.lit(""))
    if compat:
        return F.upper(F.regexp_replace(text, "[^A-Z0-9 ]", " "))
    return F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", " ")


def slugify(c, max_length: int = 64) -> Column:
    """Letters, digits, dashes and single spaces only, cut to a length."""
    text = F.regexp_replace(_col(c), r"[^A-Za-z0-9\- ]+", "")
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, max_length)
