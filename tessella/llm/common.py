"""Helpers shared by the training-data operators.

Conventions that hold in every operator of this subpackage:

* only the columns named by the caller are read, so extra columns, also ones with
  clashing names, never reach an operator's plan;
* a null text counts as an empty text unless the operator says otherwise;
* repeated rows are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, for Java, Python and RE2 patterns alike: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: Texts with more copies than this stand once where keys are emitted.
COPIES = 8

_shipped: set[str] = set()
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it.

    Unless the application sets a size itself, Arrow batches stop at BATCH bytes: 10,000 rows of long texts would take
    tens of megabytes in the JVM and again in each worker.
    """
    if BATCH_KEY not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(BATCH_KEY, str(BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(to)  # served by the driver; executors fetch their own copies
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a temporary one only where that is unset and everything runs in one process."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        had = sc._jsc.sc().getCheckpointDir()
        if not had.isDefined() and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = had.get() if had.isDefined() else tempfile.mkdtemp(prefix="tessella-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back, with the same schema."""
    spark = df.sparkSession
    to = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect garbage, so that Spark drops the shuffle files of finished steps."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1 and so on: no name of the table's can clash with one that an operator adds."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, column: str) -> str:
    """What numbered() calls a column: as Spark resolves names, the exact one first, then without regard to case."""
    names = docs.columns
    return f"c{names.index(column) if column in names else [x.lower() for x in names].index(column.lower())}"


def each_once(docs: DataFrame, text: str, hashes: DataFrame) -> DataFrame:
    """text and hash (its text_hash) of docs, without most repeats: a text with over COPIES copies comes once.

    hashes has the hash of every row. Names of such texts number at most rows / COPIES; few are sent, more are joined.
    """
    rows = docs.select(F.col(text).alias("text"), text_hash(F.col(text)).alias("hash"))
    hot = written(hashes.groupBy(F.col("hash").alias("hot")).count().where(F.col("count") > COPIES).select("hot"), "hot")
    n = hot.count()
    if not n:
        return rows
    hint = F.broadcast if n <= 1 << 20 else (lambda x: x)  # 8 bytes each
    rare = rows.join(hint(hot), F.col("hash") == F.col("hot"), "left_anti")
    once = rows.join(hint(hot), F.col("hash") == F.col("hot"), "left_semi").groupBy("hash").agg(F.first("text", ignorenulls=True).alias("text"))
    return rare.unionByName(once)


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the column as text, modulo mod; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def crc_mod_py(value: int | None, mod: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % mod


def trim() -> None:
    """Give memory that this worker has freed back to the system: workers live through many tasks, and two share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: What clears the caches that outlive a task, by owner.
_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Keep a cache in this worker until a task of another owner starts."""
    _held[owner] = clear


def few(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about limit bytes; what one slice took is given back before the next, and caches of other owners at the start."""
    for other in [x for x in _held if x != owner]:
        _held.pop(other)()
        trim()
    for b in batches:
        per = max(1, b.nbytes // max(1, b.num_rows))
        step = max(1, limit // per)
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)
            if b.nbytes > 1 << 20:
                trim()


def strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One large_string array without nulls, whose offsets start at 0 (some kernels err on slices that don't)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    data, at = raw(pc.fill_null(column.cast(pa.large_string()), ""))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array, end to end, and the n + 1 offsets into them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    all_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, flat, and the n + 1 offsets of the texts into them."""
    lists = pc.ascii_split_whitespace(texts)
    flat, at = lists.values, np.asarray(lists.offsets, np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:  # white space at either end leaves empty strings
        keep = full.to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        flat = flat.filter(full)
    return flat.slice(at[0], at[-1] - at[0]), at - at[0]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over [at[i], at[i + 1])."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return total[at[1:]] - total[at[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n at least of an odd base modulo 2^64, and of its inverse. Short tables stay with the worker, long ones don't."""
    if _POWERS and len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(max(n + 1, 1 << 17), b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64, out=x))
    if len(out[0]) == 1 << 17:
        _POWERS[:] = out
    return out[0], out[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of a polynomial in the bytes modulo 2^64; see span_hash."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), the same for equal strings wherever they stand."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def hash_strings(flat: pa.Array) -> np.ndarray:
    """A uint64 hash of each string."""
    data, at = raw(flat.cast(pa.large_string()))
    return span_hash(prefix_hash(data), at[:-1], at[1:])


def text_hash(text: Column) -> Column:
    """A 64-bit name for a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def each_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text."""
    data, at = raw(texts)
    all_ = data.tobytes()
    return [all_[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
