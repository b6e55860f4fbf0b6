"""Constraints as queries that give what breaks them, and foreign-key actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.schema import TableDef


def null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that stand more than once, with their count; nulls never clash."""
    full = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    return full.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def foreign_violations(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target; null references none."""
    return df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def check_violations(df: DataFrame, check: Column | str) -> DataFrame:
    """Rows for which a check is false; unknown is no violation."""
    return df.where(~(F.expr(check) if isinstance(check, str) else check))


def balance_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) < 0)


def on_delete(child: DataFrame, column: str, gone: DataFrame, key: str, action: str, default=None) -> DataFrame:
    """The child table after its targets in `gone` are deleted: restrict and no_action raise on read, cascade, set_null, set_default."""
    keys = gone.select(F.col(key).alias("_gone")).distinct()
    if action == "cascade":
        return child.join(keys, F.col(column) == F.col("_gone"), "left_anti")
    kind = child.schema[column].dataType
    hit = {
        "set_null": F.lit(None).cast(kind),
        "set_default": F.lit(default).cast(kind),
        "restrict": F.raise_error(F.lit(f"{column} still refers to a deleted row")).cast(kind),
        "no_action": F.raise_error(F.lit(f"{column} still refers to a deleted row")).cast(kind),
    }[action]
    out = child.join(keys, F.col(column) == F.col("_gone"), "left")
    return out.select(*[F.when(F.col("_gone").isNotNull(), hit).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in child.columns])


def validate(df: DataFrame, table: TableDef, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """constraint, violations: a row for each declared constraint of a table."""
    found: list[tuple[str, DataFrame]] = [(f"not null {f.name}", null_violations(df, f.name)) for f in table.fields if not f.nullable]
    found += [(f"unique {', '.join(c)}", unique_violations(df, list(c))) for c in table.unique]
    found += [(f"check {c}", check_violations(df, c)) for c in table.checks]
    found += [(f"foreign {c} -> {t}.{k}", foreign_violations(df, c, (others or {})[t], k)) for c, t, k, _ in table.foreign]
    spark = df.sparkSession
    out = spark.createDataFrame([], "`constraint` string, violations long")
    for name, bad in found:
        out = out.unionByName(bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("constraint"), "violations"))
    return out
