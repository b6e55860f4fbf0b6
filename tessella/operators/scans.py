"""Keyed and filtered scans. All are declarative, so that filters and columns reach the Parquet scan."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.predicates import all_of


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def find_by(df: DataFrame, column: str, value, key: str) -> DataFrame:
    """Keys of the rows whose column equals a value."""
    return df.where(F.col(column) == value).select(key)


def find_by_composite(df: DataFrame, values: dict, key: str) -> DataFrame:
    """Keys of the rows that equal a full tuple of values."""
    return df.where(all_of([F.col(c) == v for c, v in values.items()])).select(key)


def find_range(df: DataFrame, column: str, low, high, key: str) -> DataFrame:
    """Keys with low <= column <= high, in order of key."""
    return df.where(F.col(column).between(low, high)).select(key).orderBy(key)


def query(df: DataFrame, predicates: list[tuple[str, str, object]], key: str) -> DataFrame:
    """Keys of the rows that meet all of (column, operator, value), in order of key."""
    ops = {"=": lambda c, v: c == v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}
    return df.where(all_of([ops[op](F.col(c), v) for c, op, v in predicates])).select(key).orderBy(key)


def select_rows(df: DataFrame, condition: Column | str | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Filter, project, limit; which rows a limit without an order keeps is not defined."""
    out = df if condition is None else df.where(condition)
    out = out if columns is None else out.select(*columns)
    return out if limit is None else out.limit(limit)


def sequence_page(df: DataFrame, column: str, start: int, limit: int | None = None) -> DataFrame:
    """A page of an ordered log from an offset on."""
    out = df.where(F.col(column) >= start).orderBy(column)
    return out if limit is None else out.limit(limit)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text; nothing runs."""
    with redirect_stdout(out := io.StringIO()):
        df.explain(mode)
    return out.getvalue()
