"""Column expressions on texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of characters other than these: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def row_key(*columns: Column) -> Column:
    """A 64-bit key of a row by those columns, never null: rows with equal values share it, also where some are null."""
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def total(items: Column) -> Column:
    """Sum of an array of integers as a long."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    left = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)
    return (F.length(text) - F.length(left)).cast("long")
