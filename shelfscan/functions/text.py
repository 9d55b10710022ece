"""Text expressions; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def is_blank(col: Column) -> Column:
    """NULL or only spaces; never NULL itself."""
    return F.coalesce(F.trim(col) == "", F.lit(True))


def tokens(col: Column) -> Column:
    """Lower-cased word tokens, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def words(col: Column) -> Column:
    """Parts between runs of whitespace, none of them empty."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def collapse_spaces(col: Column) -> Column:
    """One space for every run of whitespace, none at the ends."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def decode_entities(col: Column) -> Column:
    """Decode five HTML entities, the ampersand first, then tidy whitespace."""
    for entity, char in HTML_ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return collapse_spaces(col)


# Entity and character, in the order they are decoded.
HTML_ENTITIES = (
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)


def normalize_query(col: Column) -> Column:
    """Offline form: single spaces, lower case."""
    return F.lower(collapse_spaces(col))


def sanitize_query(col: Column, max_length: int = 200) -> Column:
    """Online form: cut, drop unprintable characters, lower, drop ``! ? .``."""
    cut = F.substring(F.regexp_replace(col, r"^\s+|\s+$", ""), 1, max_length)
    # every separator but the plain space counts as unprintable
    printable = F.regexp_replace(cut, r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}", "")
    return F.translate(F.lower(collapse_spaces(printable)), "!?.", "")


def display(col: Column, missing: str) -> Column:
    """Text of a value, or ``missing`` for NULL."""
    return F.coalesce(col.cast("string"), F.lit(missing))


def clean_value(col: Column) -> Column:
    """The value as text, or NULL when it is blank or spells null/none."""
    text = col.cast("string")
    absent = text.isNull() | F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")).isin("", "null", "none")
    return F.when(~absent, text)


def first_value(*cols: Column) -> Column:
    """First usable value of several aliases of one field."""
    return F.coalesce(*[clean_value(c) for c in cols])
