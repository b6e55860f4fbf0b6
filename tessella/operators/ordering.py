"""Order, paging, top-n and distinct rows. Nulls stand last in ascending and first in descending order; ties are broken by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_by(column: str, descending: bool = False) -> Column:
    return F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()


def sorted_page(df: DataFrame, column: str, key: str | list[str], descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page in order of a column, ties by key; with a limit Spark keeps only the top rows of each task."""
    keys = [key] if isinstance(key, str) else key
    out = df.orderBy(order_by(column, descending), *keys)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct rows; null equals null."""
    return (df if columns is None else df.select(*columns)).distinct()
