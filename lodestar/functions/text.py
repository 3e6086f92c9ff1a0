"""Words, tokens and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What parts words: runs of signs, and the empty places of camel humps.
GAPS = r"[^\p{IsAlphabetic}\p{N}]+|(?=\p{IsUppercase})(?:(?<=\p{IsLowercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase}))"
RUN = r"[\p{IsAlphabetic}\p{N}]+"
REPEATS = r"(?<![^ ])([^ ]++)(?: \1(?![^ ]))+"


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded down."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    return F.floor(F.lit(1.3).cast("double") * F.size(words)).cast("long")


def words(text: Column) -> Column:
    """The tokens of a text in one string, with a space between; empty where there are none."""
    parted = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " "))
    return F.regexp_replace(F.trim(parted), REPEATS, "$1")


def tokens(text: Column) -> Column:
    """Lower-case words of identifiers and prose: split at signs and camel humps, repeats in a row dropped.

    Null and empty texts, and texts of signs alone, have no words. It all happens on one string before the
    split, as functions over the items of an array are interpreted, not compiled.
    """
    return F.array_remove(F.split(words(text), " "), "")


def first_token(text: Column) -> Column:
    """The first of the tokens, or null, without a look at what comes after the first run of letters and numbers."""
    return F.get(tokens(F.regexp_extract(F.coalesce(text, F.lit("")), RUN, 0)), F.lit(0))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"'`]+|[\"'`]+$", "")
