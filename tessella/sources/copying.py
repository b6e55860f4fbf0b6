"""Bulk load and unload in PostgreSQL's COPY formats: text, CSV and binary."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formats import read_csv, write_csv

#: Fixed values of the formats.
_ESCAPES = [("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ("v", "\x0b")]
_SIGNATURE = b"PGCOPY\n\xff\r\n\x00" + struct.pack(">ii", 0, 0)
_WIDTHS = {"boolean": "?", "smallint": "h", "int": "i", "bigint": "q", "float": "f", "double": "d"}
_TRUE, _FALSE = ("t", "true", "y", "yes", "on", "1"), ("f", "false", "n", "no", "off", "0")


@dataclass(frozen=True)
class CopyOptions:
    """What COPY's WITH list says. A null is written as `null`; in CSV, text that reads the same stands in quotes."""

    format: str = "text"
    delimiter: str = "\t"
    null: str = "\\N"
    header: bool = False
    quote: str = '"'
    escape: str = '"'
    columns: tuple[str, ...] = ()

    @classmethod
    def of(cls, options: dict[str, str], columns: tuple[str, ...] = ()) -> CopyOptions:
        """From option names and values. FREEZE says nothing here, other encodings than UTF-8 and FORCE_ options are refused, unknown ones have no effect."""
        have = {k.lower(): v for k, v in options.items()}
        kind = have.get("format", "text").lower()
        if kind not in ("text", "csv", "binary"):
            raise ValueError(f"COPY knows no format {kind}")
        if refused := [k for k in have if k.startswith("force_")]:
            raise ValueError(f"COPY does not take {refused[0].upper()}")
        if have.get("encoding", "utf8").lower().replace("-", "").replace("_", "") not in ("utf8", "unicode"):
            raise ValueError("COPY reads and writes UTF-8 only")
        csv = kind == "csv"
        quote = have.get("quote", '"')
        out = cls(kind, have.get("delimiter", "," if csv else "\t"), have.get("null", "" if csv else "\\N"), have.get("header", "false").lower() in _TRUE + ("match",), quote, have.get("escape", quote), columns)
        for what, x in (("DELIMITER", out.delimiter), ("QUOTE", out.quote), ("ESCAPE", out.escape)):
            if len(x) != 1 or x in "\r\n" or (what == "DELIMITER" and kind == "text" and x in "\\.abcdefghijklmnopqrstuvwxyz0123456789"):
                raise ValueError(f"COPY {what} must be one character that no escape needs: {x!r}")
        if csv and out.delimiter == out.quote:
            raise ValueError("COPY DELIMITER and QUOTE must differ")
        return out


def value(text: Column, kind: T.DataType, what: str) -> Column:
    """Text as a value of a kind, as COPY has it. Null stays null; text that is no such value raises, naming the column, the type and the text.

    Integers may come in decimal or scientific notation if no fraction is left; decimals are rounded to their scale; bytes come as \\x and hexadecimal digits.
    """
    name = kind.simpleString()

    def bad(why: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what}: {why} {name}: "), text)).cast(kind)

    trimmed = F.trim(text)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegralType | T.DecimalType):
        numeric = trimmed.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        if isinstance(kind, T.DecimalType):
            found = trimmed.try_cast(kind)
            return F.when(text.isNull(), None).when(~numeric, bad("invalid input for")).when(found.isNull(), bad("out of range for")).otherwise(found)
        plain = trimmed.rlike("^[+-]?[0-9]+$")
        exact = trimmed.try_cast("decimal(38,10)")
        found = F.when(plain, trimmed.try_cast(kind)).otherwise(exact.try_cast(kind))
        whole = plain | (exact == F.floor(exact))
        return F.when(text.isNull(), None).when(~numeric, bad("invalid input for")).when(~plain & exact.isNotNull() & ~whole, bad("not whole, for")).when(found.isNull(), bad("out of range for")).otherwise(found)
    if isinstance(kind, T.BooleanType):
        low = F.lower(trimmed)
        return F.when(text.isNull(), None).when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False).otherwise(bad("invalid input for"))
    if isinstance(kind, T.BinaryType):
        found = F.unhex(F.substring(text, 3, 1 << 30))
        return F.when(text.isNull(), None).when(text.startswith("\\x") & found.isNotNull(), found).otherwise(bad("invalid input for"))
    found = trimmed.try_cast(kind)
    return F.when(text.isNull(), None).when(found.isNull(), bad("invalid input for")).otherwise(found)


def _shown(df: DataFrame) -> list[Column]:
    """The columns as COPY writes them, before anything is escaped."""
    out = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            x = F.when(x, "t").when(~x, "f")
        elif isinstance(f.dataType, T.BinaryType):
            x = F.concat(F.lit("\\x"), F.lower(F.hex(x)))
        out.append(x.cast("string"))
    return out


#: Parts of a cell of the text format: an escape, or what stands between two.
_TOKEN = r"(?s)\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\.|[^\\]+"


def _unescaped(cell: Column, null: str) -> Column:
    """A cell's text. Bytes that come as octal or hexadecimal escapes are put together before they are read as UTF-8."""

    def plain(t: Column) -> Column:
        out = F.when(~t.startswith("\\"), t)
        for letter, char in _ESCAPES:
            out = out.when(t == "\\" + letter, F.lit(char))
        return out.otherwise(F.substring(t, 2, 1 << 30))

    def coded(t: Column) -> Column:
        octal = F.lpad(F.hex(F.conv(F.substring(t, 2, 3), 8, 10).cast("long").bitwiseAND(F.lit(255))), 2, "0")
        return F.when(t.rlike(r"^\\x[0-9A-Fa-f]"), F.lpad(F.substring(t, 3, 2), 2, "0")).when(t.rlike(r"^\\[0-7]"), octal).otherwise(F.hex(plain(t)))

    def quick(part: Column) -> Column:
        for letter, char in _ESCAPES:
            part = F.replace(part, F.lit("\\" + letter), F.lit(char))
        return F.regexp_replace(part, r"(?s)\\(.)", "$1")

    tokens = F.regexp_extract_all(cell, F.lit(_TOKEN), F.lit(0))
    bytes_ = F.decode(F.unhex(F.array_join(F.transform(tokens, coded), "")), "UTF-8")
    chars = F.array_join(F.transform(F.split(cell, r"\\\\", -1), quick), "\\")
    return F.when(cell == null, None).when(~cell.contains("\\"), cell).when(cell.rlike(r"\\(x[0-9A-Fa-f]|[0-7])"), bytes_).otherwise(chars)


def _without_first(lines: DataFrame) -> DataFrame:
    """Lines but the first of each file. Only a split that starts at 0 holds it, as its first row."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, place in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if place != seen:
                    seen = place
                    keep[i] = place[1] != 0
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep))], ["value"])

    return lines.select("value", "_metadata.file_path", "_metadata.file_block_start").mapInArrow(drop, "value string")


def read_copy_text(spark: SparkSession, path: str, schema: str, options: CopyOptions = CopyOptions()) -> DataFrame:
    """COPY's text format: a line for each row, backslash escapes, a null mark. A row with another number of cells raises."""
    lines = spark.read.text(path, lineSep="\n")
    return parsed(_without_first(lines) if options.header else lines, schema, options)


def parsed(lines: DataFrame, schema: str, options: CopyOptions = CopyOptions()) -> DataFrame:
    """Lines (value) of the text format as rows; the line \\. that ends a transfer is none."""
    kind = T.StructType.fromDDL(schema)
    lines = lines.where("value <> '\\\\.'")
    # no line holds a line feed, so two of them stand for an escaped backslash and an escaped delimiter while the line is split
    slash, mark = F.lit("\nA"), F.lit("\nB")
    bare = F.replace(F.replace("value", F.lit("\\\\"), slash), F.lit("\\" + options.delimiter), mark)
    cells = F.transform(F.split(bare, re.escape(options.delimiter), -1), lambda x: F.replace(F.replace(x, mark, F.lit("\\" + options.delimiter)), slash, F.lit("\\\\")))
    whole = (F.size(cells) == len(kind)) & ~bare.endswith("\\")
    full = F.when(whole, cells).otherwise(F.raise_error(F.concat(F.lit("wrong number of cells, or a backslash at the end: "), F.col("value"))).cast("array<string>"))
    rows = lines.select(full.alias("c"))
    return rows.select(*[value(_unescaped(F.col("c")[i], options.null), f.dataType, f.name).alias(f.name) for i, f in enumerate(kind.fields)])


def write_copy_text(df: DataFrame, path: str, options: CopyOptions = CopyOptions()) -> None:
    cells = []
    for x in _shown(df):
        out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        for letter, char in _ESCAPES:
            out = F.replace(out, F.lit(char), F.lit("\\" + letter))
        if options.delimiter != "\t":
            out = F.replace(out, F.lit(options.delimiter), F.lit("\\" + options.delimiter))
        # text that reads like the null mark gets an escape that stands for its first character
        alike = F.concat(F.lit("\\x" + "".join(f"{b:02x}" for b in options.null[:1].encode())), F.substring(out, 2, 1 << 30)) if options.null and not options.null.startswith("\\") else out
        cells.append(F.when(x.isNull(), F.lit(options.null)).when(out == options.null, alike).otherwise(out))
    lines = df.select(F.concat_ws(options.delimiter, *cells).alias("value"))
    if options.header:  # one in each part file
        names = options.delimiter.join(df.columns)
        lines = lines.mapInArrow(_led_by(names), "value string")
    lines.write.text(path)


def _led_by(line: str):
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([line])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    return lead


_CSV = CopyOptions("csv", ",", "")


def read_copy_csv(spark: SparkSession, path: str, schema: str, options: CopyOptions = _CSV, multi_line: bool = True) -> DataFrame:
    """COPY's CSV: bare empty cells are null and quoted ones are empty text (with another null mark: cells that read like it are null).

    Cells may hold line feeds; without multi_line they must not, and large files are read in splits.
    """
    kind = T.StructType.fromDDL(schema)
    rows = read_csv(spark, path, kind.names, options.delimiter, options.header, options.null, options.quote, options.escape, multi_line, empty="")
    return rows.select(*[value(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in kind.fields])


def write_copy_csv(df: DataFrame, path: str, options: CopyOptions = _CSV) -> None:
    shown = df.select(*[x.alias(f.name) for x, f in zip(_shown(df), df.schema.fields)])
    write_csv(shown, path, options.delimiter, options.header, options.null, options.quote, options.escape)


def to_copy_binary(df: DataFrame) -> DataFrame:
    """A column `content` with whole COPY binary files, one for each Arrow batch: write it with a sink of your choice, or read it back with from_copy_binary."""
    kinds = [f.dataType.simpleString() for f in df.schema.fields]

    def cell(value, kind: str) -> bytes:
        if value is None:
            return struct.pack(">i", -1)
        body = struct.pack(">" + _WIDTHS[kind], value) if kind in _WIDTHS else bytes(value) if kind == "binary" else str(value).encode()
        return struct.pack(">i", len(body)) + body

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_SIGNATURE]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out.append(struct.pack(">h", len(kinds)))
                out += [cell(x, k) for x, k in zip(row, kinds)]
            out.append(struct.pack(">h", -1))
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["content"])

    return df.mapInArrow(encode, "content binary")


def from_copy_binary(files: DataFrame, schema: str) -> DataFrame:
    """Rows of COPY binary files in a column `content`, as spark.read.format("binaryFile") gives them."""
    kind = T.StructType.fromDDL(schema)
    kinds = [f.dataType.simpleString() for f in kind.fields]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(f.dataType) for f in kind.fields]
        for b in batches:
            for data in b.column(0).to_pylist():
                if not data.startswith(_SIGNATURE[:11]):
                    raise ValueError("no COPY binary file")
                at = 19 + struct.unpack_from(">i", data, 15)[0]
                columns: list[list] = [[] for _ in kinds]
                while (n := struct.unpack_from(">h", data, at)[0]) >= 0:
                    at += 2
                    if n != len(kinds):
                        raise ValueError("wrong number of cells")
                    for column, k in zip(columns, kinds):
                        size = struct.unpack_from(">i", data, at)[0]
                        at += 4
                        if size < 0:
                            column.append(None)
                            continue
                        body = data[at : at + size]
                        at += size
                        column.append(struct.unpack(">" + _WIDTHS[k], body)[0] if k in _WIDTHS else body if k == "binary" else body.decode())
                yield pa.RecordBatch.from_arrays([pa.array(c, a) for c, a in zip(columns, arrow)], kind.names)

    return files.select("content").mapInArrow(decode, schema)


def copy_from(spark: SparkSession, path: str, schema: str, options: CopyOptions) -> DataFrame:
    if options.format == "binary":
        return from_copy_binary(spark.read.format("binaryFile").load(path), schema)
    return (read_copy_csv if options.format == "csv" else read_copy_text)(spark, path, schema, options)


def copy_to(df: DataFrame, path: str, options: CopyOptions) -> None:
    if options.format == "binary":
        # Spark has no writer of bare bytes: the driver writes them, one of some megabytes at a time
        write_files(to_copy_binary(df), path)
    else:
        (write_copy_csv if options.format == "csv" else write_copy_text)(df, path, options)


def write_files(files: DataFrame, path: str) -> None:
    """Each binary of a one-column table as a file of the folder, by Hadoop's own file systems, so in any store that Spark writes to."""
    spark = files.sparkSession
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, row in enumerate(files.toLocalIterator()):  # one file at a time is on the driver
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/part-{i:06d}.copy"), False)
        out.write(bytes(row[0]))
        out.close()
