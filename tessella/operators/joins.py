"""Equi-joins, chains and subqueries. Null keys match nothing. Spark picks broadcast, hash or sort-merge by size, and splits skewed partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(df: DataFrame, table: str) -> DataFrame:
    """df with columns named table.column, as combined rows have them."""
    return df.select(*[F.col(f"`{c}`").alias(f"{table}.{c}") for c in df.columns])


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """left.* and right.* with how inner, left, right or full; the order of columns never changes."""
    return left.join(right, left[f"`{left_key}`"] == right[f"`{right_key}`"], how).select(*[left[f"`{c}`"] for c in left.columns], *[right[f"`{c}`"] for c in right.columns])


def chain_join(tables: list[tuple[str, DataFrame]], links: list[tuple[str, str]]) -> DataFrame:
    """Inner joins, left to right: links[i] are the two table.column names that tie table i + 1 to one before it. A table may come twice under two names."""
    seen = {tables[0][0]}
    out = named(tables[0][1], tables[0][0])
    for (name, df), (a, b) in zip(tables[1:], links):
        if name in seen:
            raise ValueError(f"{name} stands twice: give it another name")
        sides = {a.split(".")[0]: a, b.split(".")[0]: b}
        if name not in sides or len(sides) < 2 or not (sides.keys() - {name}) <= seen:
            raise ValueError(f"{a} = {b} does not tie {name} to a table before it")
        old = next(v for k, v in sides.items() if k != name)
        out = equi_join(out, named(df, name), old, sides[name])
        seen.add(name)
    return out


def in_subquery(df: DataFrame, column: str, inner: DataFrame) -> DataFrame:
    """column IN (inner): a semi join."""
    one = inner.select(F.col(inner.columns[0]).alias("_in"))
    return df.join(one, df[column] == one["_in"], "left_semi")


def not_in_subquery(df: DataFrame, column: str, inner: DataFrame, skip_nulls: bool = False) -> DataFrame:
    """column NOT IN (inner). SQL's rule: a null inside leaves nothing, and a null outside goes unless inner is empty; skip_nulls ignores nulls inside and keeps nulls outside only if inner has no value."""
    one = inner.select(F.col(inner.columns[0]).alias("_in"))
    if skip_nulls:
        one = one.where("_in IS NOT NULL")
    some = one.agg(F.count(F.lit(1)).alias("_n"), F.count("_in").alias("_v"))  # one row
    out = df.join(one, df[column] == one["_in"], "left_anti").join(F.broadcast(some), how="cross")
    return out.where((F.col("_n") == 0) | ((F.col("_n") == F.col("_v")) & F.col(column).isNotNull())).select(*df.columns)


def compare_scalar(df: DataFrame, column: str, op: str, inner: DataFrame) -> DataFrame:
    """column op (inner): inner has one column; more than one row raises, none or null keeps nothing."""
    if len(inner.columns) != 1:
        raise ValueError("a scalar subquery has one column")
    value = inner.select(F.col(inner.columns[0]).alias("_v")).agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a scalar subquery gave more than one row")).cast(inner.dtypes[0][1])).otherwise(F.max("_v")).alias("_v")
    )  # one row
    x, v = F.col(column), F.col("_v")
    leaf: dict[str, Column] = {"=": x == v, "<>": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}
    return df.join(F.broadcast(value), how="cross").where(leaf[op]).select(*df.columns)


def union_ids(*sides: DataFrame) -> DataFrame:
    """Distinct keys of all sides, in order."""
    out = sides[0]
    for s in sides[1:]:
        out = out.union(s)
    return out.distinct().orderBy(out.columns[0])


def intersect_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right).orderBy(left.columns[0])


def except_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right).distinct().orderBy(left.columns[0])
