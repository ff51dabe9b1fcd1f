"""Text functions with the semantics of byte strings and Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a word, with an optional apostrophe and one letter.
WORD = "[a-zA-Z]+('[a-z])?"


def extract_words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def byte_length(text: Column) -> Column:
    """Length in UTF-8 bytes, not characters."""
    return F.octet_length(text).cast("bigint")


def is_blank(text: Column) -> Column:
    """Whether a text is empty or white space of any script."""
    return text.rlike(r"(?U)^\s*$")


def split_lines(text: Column) -> Column:
    """Lines that end in a newline, and a last one that does not unless it is empty.

    Carriage returns stay in the line; blank lines are kept.
    """
    parts = F.split(text, "\n")
    last = F.element_at(parts, -1) == ""
    return F.when(last, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
