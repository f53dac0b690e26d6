"""Text and identifier-list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Company suffixes that clean_text drops (fixed values).
SUFFIXES = ("inc", "incorporated", "llc", "corp", "corporation", "ltd", "limited", "co", "company")
#: Runs of two or more letters, digits or underscores; combining marks end a run.
TOKEN = "[\\p{L}\\p{N}_]{2,}"


def clean_text(text: Column) -> Column:
    """Lower case, ASCII letters and digits only, company suffixes dropped, single spaces."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\s]", " ")
    bare = F.regexp_replace(plain, f"\\b({'|'.join(SUFFIXES)})\\b", " ")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def block_key(country: Column) -> Column:
    """Country trimmed and in capitals; null is blank."""
    return F.upper(F.trim(F.coalesce(country, F.lit(""))))


def joined(*columns: Column) -> Column:
    """Columns joined with a space, nulls as blank."""
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def terms(words: Column) -> Column:
    """Words and their adjacent pairs."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def parse_ids(ids: Column) -> Column:
    """Comma list to array: trimmed, blanks dropped; null is empty."""
    return F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_ids_strict(ids: Column) -> Column:
    """Comma list to array without trimming; blanks stay."""
    return F.split(ids, ",")


def format_ids(ids: Column) -> Column:
    return F.array_join(ids, ",")


def words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda x: x != "")


def has_non_ascii(text: Column) -> Column:
    return text.rlike("[^\\x00-\\x7F]")
