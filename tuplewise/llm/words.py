"""Words of texts as Spark arrays, and helpers for expressions over arrays; no Python runs on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z is lower-case: all ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of a text's words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def span(n: Column, body: Callable[[Column], Column], kind: str) -> Column:
    """Array of body(1), ..., body(n); of type `kind`, empty for n < 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), body)).otherwise(F.array().cast(f"array<{kind}>"))
