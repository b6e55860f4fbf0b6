"""Files as tables: JSON arrays and envelopes, NDJSON, CSV, Parquet; each column of a source has a path and a declared kind.

Whatever does not fit its kind raises when the rows are read: a refresh is all or nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.schema import Kind


@dataclass(frozen=True)
class SourceColumn:
    name: str
    kind: Kind
    path: str


@dataclass(frozen=True)
class SourceDef:
    """An external source: format json, ndjson, csv or parquet; rows is the dotted path of the array inside a JSON envelope."""

    name: str
    columns: tuple[SourceColumn, ...]
    format: str
    key: str
    rows: str = ""

    def __post_init__(self):
        if self.key not in {c.name for c in self.columns}:
            raise ValueError(f"key {self.key} is no column of {self.name}")


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def _typed(rows: DataFrame, source: SourceDef, cell) -> DataFrame:
    return rows.select(*[c.kind.coerce(cell(c), f"{source.name}.{c.name}").alias(c.name) for c in source.columns])


def _json_cell(record: str):
    def cell(c: SourceColumn) -> Column:
        text = F.get_json_object(F.col(record), _json_path(c.path))
        scalar = ~text.rlike(r"^\s*[\[{]")
        return F.when(scalar | text.isNull(), text).otherwise(F.raise_error(F.lit(f"{c.path} is no scalar")))

    return cell


def read_source(spark: SparkSession, source: SourceDef, path: str) -> DataFrame:
    """The source's rows, typed. Numbers of JSON keep their text until they are cast."""
    if source.format == "json":
        whole = spark.read.text(path, wholetext=True)
        array = F.get_json_object("value", _json_path(source.rows)) if source.rows else F.col("value")
        items = F.from_json(array, "array<string>", {"mode": "FAILFAST"})
        some = F.when(items.isNull(), F.raise_error(F.lit("no JSON array")).cast("array<string>")).otherwise(items)
        return _typed(whole.select(F.explode(some).alias("_r")), source, _json_cell("_r"))
    if source.format == "ndjson":
        lines = spark.read.text(path).where(F.trim("value") != "")
        ok = F.when(F.json_object_keys("value").isNull(), F.raise_error(F.concat(F.lit("no JSON object: "), F.col("value")))).otherwise(F.col("value"))
        return _typed(lines.select(ok.alias("_r")), source, _json_cell("_r"))
    if source.format == "csv":
        return _typed(read_csv(spark, path), source, lambda c: F.col(f"`{c.path}`"))
    if source.format == "parquet":
        return _typed(read_parquet(spark, path), source, lambda c: _text(c.path))
    raise ValueError(f"no format {source.format}")


def _text(path: str) -> Column:
    return F.col(path).cast("string")


#: What no cell reads like: with it as null mark, bare empty cells are null and quoted ones are not.
_NO_CELL = "\x01\x02\x01"


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", header: bool = True, null: str = "", quote: str = '"', escape: str = '"', multi_line: bool = False, empty: str | None = None) -> DataFrame:
    """CSV with quotes doubled inside quotes; short and long rows raise.

    Files are read in splits; with multi_line cells may hold line feeds, and a file is one task. Bare empty cells are null (if that is
    the null mark), and so are quoted ones unless `empty` says what they are.
    """
    how = {"header": header, "sep": sep, "quote": quote, "escape": escape, "multiLine": multi_line}
    names = columns or spark.read.csv(path, inferSchema=False, **how).columns
    schema = ", ".join(f"`{c}` string" for c in names)
    mark = _NO_CELL if empty is not None and null == "" else null
    return spark.read.csv(path, schema=schema, nullValue=mark, emptyValue=null if empty is None else empty, mode="FAILFAST", enforceSchema=columns is not None, **how)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, null: str = "", quote: str = '"', escape: str = '"') -> None:
    """Null as its mark, empty text as two quotes; cells with quotes, delimiters or line feeds stand in quotes."""
    df.write.csv(path, sep=sep, header=header, quote=quote, escape=escape, emptyValue=quote * 2, nullValue=null, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet with any codec that Spark has; of columns only those named are read."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_parquet_brotli(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet whose codec Spark lacks: executors read whole files as binary and decode them with pyarrow, a row group at a time. schema is the result's."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def decode(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                file = pq.ParquetFile(pa.BufferReader(content))
                for part in file.iter_batches(batch_size=8192):
                    yield part

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, schema)


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; other columns as they are."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields])


def parquet_bounds(spark: SparkSession, path: str, column: str) -> DataFrame:
    """low, high and n of a column of numbers, booleans or dates, from the files' footers: no row is read."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("n"))


def json_lines(df: DataFrame) -> DataFrame:
    """line: each row as a JSON object; nulls stand as null."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("line"))


def text_table(df: DataFrame, rows: int = 100) -> str:
    """The first rows as an aligned table, for people: numbers to the right, other values to the left, nulls empty."""
    got = [[("" if v is None else str(v)) for v in r] for r in df.limit(rows).collect()]
    wide = [max([len(c), *(len(r[i]) for r in got)]) for i, c in enumerate(df.columns)]
    right = [f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") for f in df.schema.fields]
    line = lambda r: " | ".join(v.rjust(w) if x else v.ljust(w) for v, w, x in zip(r, wide, right)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in wide), *map(line, got)])


#: What row identities are hashed with; a source that shares identities with another system passes that system's tag.
ROW_TAG = b"tessella-row\0"


def row_id(type_id: int, key: Column, tag: bytes = ROW_TAG) -> Column:
    """A stable 128-bit identity for a source's row: half of the SHA-256 of a tag, the type and the key."""
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(tag), F.lit(type_id.to_bytes(4, "little")), F.encode(key.cast("string"), "UTF-8")), 256), 1, 32))
