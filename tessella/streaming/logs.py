"""Append logs and refreshes as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.changes import latest, numbered
from tessella.sources import copying
from tessella.sources.refresh import VersionedTable


def append(log: VersionedTable, payloads: DataFrame, order: list[str]) -> int:
    """Append payloads with the next sequence numbers, in a given order; numbers have no gaps. Only the new rows are written."""
    base = log.version()
    start = (log.read(base).agg(F.max("seq")).head()[0] or 0) + 1 if base else 1
    return log.append(numbered(payloads, "seq", order, start), base)


def append_once(log: VersionedTable, payloads: DataFrame, key: list[str], order: list[str]) -> int:
    """Append the payloads whose (client, request) key is not in the log yet; of several with a key one."""
    new = payloads.dropDuplicates(key)
    if log.version():
        new = new.join(log.read().select(*key), key, "left_anti")
    return append(log, new, order)


def read_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def merged(table: VersionedTable, key: str, order: str) -> DataFrame:
    """What refresh_stream() has merged so far: of each key the row that is last in order."""
    return latest(table.read(), key, order)


def refresh_stream(stream: DataFrame, table: VersionedTable, key: str, order: str, checkpoint: str, then: Callable[[], None] | None = None, compact: int = 50):
    """Merge each micro-batch into a table that merged() reads: of each key the row that is last in order stays, also if an older one comes later.

    A batch is pre-merged and appended, so it costs its own size; once the table has `compact` parts it is rewritten as one. A batch that is
    replayed changes nothing that merged() reads. Runs until all input is read.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        table.append(latest(batch, key, order))
        if len(table.parts()) >= compact:
            base = table.version()
            table.write(latest(table.read(base), key, order), base)
        if then:
            then()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, key: list[str], event_time: str, late: str) -> DataFrame:
    """Each key once, with state that a watermark bounds."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, event_time: str, window: str, late: str, by: str) -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are left out."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, window), by).agg(F.count(F.lit(1)).alias("n"))


def copy_stream(spark: SparkSession, path: str, schema: str, table: VersionedTable, checkpoint: str, options: copying.CopyOptions = copying.CopyOptions(), per_trigger: int = 100):
    """Files of COPY text, as they come to a folder, appended to a table: a micro-batch counts whole or not at all. Files have no header."""

    def one(batch: DataFrame, epoch: int) -> None:
        table.append(copying.parsed(batch, schema, options))

    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
