"""Changes as relations: each gives the table after the change and the rows it touched (RETURNING)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import materialised


def insert(df: DataFrame, rows: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Append rows; a key that is there or comes twice raises when the result is read."""
    new = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    if key is not None:
        had = df.select(F.col(key).alias("_had")).distinct()
        twice = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
        checked = new.withColumn("_twice", twice).join(had, F.col(key) == F.col("_had"), "left")
        bad = F.col("_twice") | F.col("_had").isNotNull()
        new = checked.withColumn(key, F.when(bad, F.raise_error(F.concat(F.lit("key exists: "), F.col(key).cast("string"))).cast(df.schema[key].dataType)).otherwise(F.col(key))).select(*df.columns)
    return df.unionByName(new), new


def update_where(df: DataFrame, condition: Column, sets: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Set columns where the condition is true; touched rows are as they are after."""
    hit = F.coalesce(condition, F.lit(False))
    after = df.select(*[F.when(hit, sets[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in df.columns])
    touched = df.where(condition).select(*[sets[c].cast(df.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in df.columns])
    return after, touched


def delete_where(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Delete where the condition is true; touched rows are as they were."""
    return df.where(~F.coalesce(condition, F.lit(False))), df.where(condition)


def upsert(df: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """rows over df by key; of several rows with a key the last in order stays. Keys that rows lack stay as they are."""
    new = latest(rows, key, order) if order else rows
    new = new.select(*df.columns)
    return df.join(new, key, "left_anti").select(*df.columns).unionByName(new)


def update_set(df: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """df with the non-null fields of patch, by key."""
    other = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in patch.columns if c != key])
    return df.join(other, F.col(key) == F.col("_key"), "left").select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in patch.columns and c != key else F.col(c) for c in df.columns])


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key. max_by aggregates before the shuffle, so a hot key is no problem."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_r")).select("_r.*")


def snapshot(versions: DataFrame, key: str, order: str, at: int, deleted: str | None = None) -> DataFrame:
    """Of each key the newest version not after `at`; keys whose newest version is a tombstone are gone."""
    out = latest(versions.where(F.col(order) <= at), key, order)
    return out if deleted is None else out.where(~F.coalesce(F.col(deleted), F.lit(False)))


def has_version_in_range(versions: DataFrame, key: str, order: str, low: int, high: int) -> DataFrame:
    """Keys that changed after low and not after high: what a conflict check asks for."""
    return versions.where((F.col(order) > low) & (F.col(order) <= high)).select(key).distinct()


def collect_garbage(versions: DataFrame, key: str, order: str, mark: int) -> DataFrame:
    """Versions that a snapshot at or after mark can still see."""
    last = versions.where(F.col(order) <= mark).groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_last"))
    return versions.join(last, F.col(key) == F.col("_key"), "left").where(F.col("_last").isNull() | (F.col(order) >= F.col("_last"))).select(*versions.columns)


def write_conflicts(mine: DataFrame, versions: DataFrame, key: str, order: str, started: int | Column) -> DataFrame:
    """First committer wins: the keys of a write set that others committed after the snapshot."""
    return mine.select(key).distinct().join(versions.where(F.col(order) > started).select(key).distinct(), key, "left_semi")


def numbered(df: DataFrame, name: str, order: list[str], start: int = 1) -> DataFrame:
    """Serial numbers from start in a given order, without one task over all rows: ranges are sorted apart and shifted by the counts before them."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialised(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))  # ranges are sampled anew each time
    counts = dict(ranged.groupBy("_p").count().collect())  # one row for each partition
    before, n = [], start
    for p in range(parts):
        before.append((p, n))
        n += counts.get(p, 0)
    shift = F.broadcast(spark.createDataFrame(before, "_p int, _from long"))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_n", nth).join(shift, "_p").withColumn(name, F.col("_from") + F.col("_n") - 1).select(*df.columns, name)


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    return df.withColumn(name, F.lit(default).cast(kind))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)
