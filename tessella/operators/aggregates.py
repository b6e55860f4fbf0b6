"""Scalar and grouped aggregates: partial before the shuffle, final after it.

compat=True gives the fixed answers over no rows (0) and the truncating integer average; the default is SQL's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import order_by


@dataclass(frozen=True)
class Agg:
    """An aggregate: count, sum, min, max, avg or int_avg of a column or expression, under a name."""

    kind: str
    of: Column | str | None
    name: str

    def column(self, compat: bool = False) -> Column:
        x = F.col(self.of) if isinstance(self.of, str) else self.of
        if self.kind == "count":
            return F.count(F.lit(1) if x is None else x).alias(self.name)
        if self.kind == "int_avg" or (self.kind == "avg" and compat):
            out = int_avg(x)
        else:
            out = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[self.kind](x)
        return (F.coalesce(out, F.lit(0)) if compat else out).alias(self.name)


def int_avg(x: Column) -> Column:
    """The average of integers, cut towards zero; null over nothing."""
    return F.call_function("div", F.sum(x), F.nullif(F.count(x), F.lit(0)))


def sum_exact(x: Column) -> Column:
    """A sum that cannot overflow 64 bits."""
    return F.sum(x.cast("decimal(38,0)"))


def aggregate(df: DataFrame, aggs: list[Agg], condition: Column | str | None = None, compat: bool = False) -> DataFrame:
    out = df if condition is None else df.where(condition)
    return out.agg(*[a.column(compat) for a in aggs])


def group_aggregate(df: DataFrame, keys: list[str], aggs: list[Agg], *, condition: Column | str | None = None, having: Column | str | None = None, order: str | None = None, descending: bool = False, offset: int = 0, limit: int | None = None, compat: bool = False) -> DataFrame:
    """Filter, group, aggregate, filter groups, order (ties by key), page; limit applies with or without an order."""
    out = (df if condition is None else df.where(condition)).groupBy(*keys).agg(*[a.column(compat) for a in aggs])
    out = out if having is None else out.where(having)
    if order is not None:
        out = out.orderBy(order_by(order, descending), *keys)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)
