"""Word splitting in native expressions, shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters other than digits and lower-case letters separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``; null: none."""
    return _split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def quick_words_of(text: Column) -> Column:
    """The words of ``words_of``; texts of ASCII alone are lower-cased by the faster built-in, which does the same to them."""
    held = F.coalesce(text, F.lit(""))
    return _split(F.when(F.octet_length(held) == F.length(held), F.lower(held)).otherwise(F.translate(held, UPPER, LOWER)))


def _split(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, SEPARATORS), "")
