"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters between words: space and the ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Array of the lines of a text, cut at line feeds; null counts as empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def without(text: Column, characters: str) -> Column:
    """The text without these characters."""
    return F.translate(text, characters, "")


def text_hash(text: Column) -> Column:
    """With the doc_id it tells rows apart; null is taken as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
