"""Predicates. The default is SQL's three-valued logic; two_valued() and the compare() family offer the other on request.

Two-valued means: a comparison with a null is false, before any NOT, so NOT of it is true. Never mix the two in one condition
unseen: each helper says which it gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_valued(leaf: Column) -> Column:
    """A comparison that is false where it would be null."""
    return F.coalesce(leaf, F.lit(False))


def compare(left: Column, op: str, right: Column, padded: bool = False) -> Column:
    """left op right, two-valued; padded compares text without trailing NUL and space."""
    a, b = (pad_trim(left), pad_trim(right)) if padded else (left, right)
    leaf = {"=": a == b, "<>": a != b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return two_valued(leaf)


def pad_trim(text: Column) -> Column:
    """Text without its trailing NULs and spaces, as fixed-width text compares."""
    return F.rtrim(text, F.lit("\x00 "))


def in_list(value: Column, items: list) -> Column:
    """SQL IN: an empty list is false; ANY (ARRAY[...]) is the same."""
    return value.isin(*items) if items else F.lit(False)


def like_plain(text: Column, pattern: str) -> Column:
    """LIKE with % and _ and no escape character."""
    return text.like(pattern.replace("\\", "\\\\"))


def like_bytes(text: Column, pattern: str) -> Column:
    """LIKE over UTF-8 bytes: _ is one byte. Only patterns with _ differ, and only on text beyond ASCII."""
    if "_" not in pattern:
        return like_plain(text, pattern)
    one = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")  # noqa: E731  a character for each byte
    return one(text).like("".join(c if c in "%_" else "".join(map(chr, c.encode())).replace("\\", "\\\\") for c in pattern))


def truthy(value: Column) -> Column:
    """A bare term as a condition: an integer other than zero."""
    return two_valued(value.cast("boolean"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
