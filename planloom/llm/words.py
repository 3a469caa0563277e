"""Words, numbers and answers of texts, as the operators on texts take them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A separator between the thousands of a number.
_THOUSANDS = r"(?<=\d)[,'’  ٬](?=\d{3}(?!\d))"


def joined_numbers(text: Column) -> Column:
    """``text`` without separators within numbers."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _THOUSANDS, "")


def words(text: Column) -> Column:
    """The longest runs of letters and digits, in lower case; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def plain_number(text: Column) -> Column:
    """A decimal number without leading zeros, and without a fraction of zeros: equal numbers are equal texts."""
    bare = F.regexp_replace(text, r"^(-?)0+(?=\d)", "$1")
    return F.regexp_replace(F.regexp_replace(bare, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def numbers(text: Column) -> Column:
    """The numbers that a text states, in their order."""
    return numbers_of(joined_numbers(text))


def numbers_of(joined: Column) -> Column:
    """The numbers that a text without separators in them states."""
    return F.transform(F.regexp_extract_all(joined, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), plain_number)


def answer_number(text: Column) -> Column:
    """The number that an answer gives, whatever mark, unit, currency or layout is around it; NULL if it gives none."""
    found = F.regexp_extract(joined_numbers(text), r"(?<![\p{L}\p{N}.])[-−]?\d+(?:\.\d+)?", 0)
    return F.when(found != "", plain_number(F.regexp_replace(found, "−", "-")))
