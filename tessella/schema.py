"""Declared tables: field kinds, their Spark types, and checked coercion of text cells."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The SQL spellings of kinds that are widths under another name.
SPELLINGS = {
    "SMALLINT": "I16", "SMALLSERIAL": "I16", "INTEGER": "I32", "INT": "I32", "SERIAL": "I32", "BIGINT": "I64", "BIGSERIAL": "I64",
    "BOOLEAN": "BOOL", "VARCHAR": "CHAR", "TIMESTAMP": "TS",
}
_INTEGERS = {"U8": T.ShortType(), "U16": T.IntegerType(), "U32": T.LongType(), "U64": T.DecimalType(20, 0), "U128": T.DecimalType(38, 0), "I8": T.ByteType(), "I16": T.ShortType(), "I32": T.IntegerType(), "I64": T.LongType(), "I128": T.DecimalType(38, 0)}
SERIALS = ("SERIAL", "BIGSERIAL", "SMALLSERIAL")


@dataclass(frozen=True)
class Kind:
    """A field kind: name, and the length of CHAR and BYTES or the scale of FIXED."""

    name: str
    size: int = 0

    @classmethod
    def parse(cls, text: str) -> Kind:
        m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\d+)\s*\))?\s*", text)
        if not m:
            raise ValueError(f"no kind: {text!r}")
        name = SPELLINGS.get(m[1].upper(), m[1].upper())
        if name in ("CHAR", "BYTES") and not m[2]:
            raise ValueError(f"{name} needs a length")
        if name not in _INTEGERS and name not in ("CHAR", "BYTES", "BOOL", "TS", "FIXED", "REF"):
            raise ValueError(f"no kind: {text!r}")
        return cls(name, int(m[2] or 0))

    @property
    def spark(self) -> T.DataType:
        """The Spark type. Nanosecond timestamps stay long, so that nothing is cut off."""
        if self.name in _INTEGERS:
            return _INTEGERS[self.name]
        return {"CHAR": T.StringType(), "BYTES": T.BinaryType(), "REF": T.BinaryType(), "BOOL": T.BooleanType(), "TS": T.LongType(), "FIXED": T.DecimalType(18, self.size)}[self.name]

    def bounds(self) -> tuple[int, int] | None:
        """The least and the greatest integer, as far as Spark's decimals reach."""
        if self.name not in _INTEGERS:
            return None
        bits, top = int(self.name[1:]), 10**38 - 1
        lo, hi = (0, 2**bits - 1) if self.name[0] == "U" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
        return max(lo, -top), min(hi, top)

    def coerce(self, cell: Column, what: str) -> Column:
        """The cell's text as this kind; anything that does not fit raises, and so does null."""
        bad = lambda why: F.raise_error(F.concat(F.lit(f"{what}: {why}: "), F.coalesce(cell, F.lit("NULL"))))
        text = cell.cast("string")
        if limits := self.bounds():
            number = text.try_cast("decimal(38,0)")
            ok = text.rlike(r"^[+-]?[0-9]+$") & number.between(F.lit(str(limits[0])).cast("decimal(38,0)"), F.lit(str(limits[1])).cast("decimal(38,0)"))
            return F.when(ok, number.cast(self.spark)).otherwise(bad("no integer of this width"))
        if self.name == "BOOL":
            low = F.lower(text)
            return F.when(low.isin("1", "true"), F.lit(True)).when(low.isin("0", "false"), F.lit(False)).otherwise(bad("no boolean"))
        if self.name == "CHAR":
            return F.when(F.octet_length(text) <= self.size, text).otherwise(bad("too long"))
        if self.name == "BYTES":
            return F.when(F.octet_length(text) <= self.size, text.cast("binary")).otherwise(bad("too long"))
        if self.name == "TS":
            return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint")).otherwise(bad("no nanoseconds"))
        return bad(f"{self.name} cannot come from a source")


@dataclass(frozen=True)
class FieldDef:
    name: str
    kind: Kind
    nullable: bool = True
    default: object = None


@dataclass
class TableDef:
    """A declared table: what a Spark schema has no slot for."""

    name: str
    fields: list[FieldDef]
    key: str | None = None
    unique: list[tuple[str, ...]] = field(default_factory=list)
    foreign: list[tuple[str, str, str, str]] = field(default_factory=list)  # column, other table, its column, action
    checks: list[str] = field(default_factory=list)
    indexes: list[tuple[str, ...]] = field(default_factory=list)  # hints only

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.kind.spark, f.nullable, {"field_id": i, "kind": f.kind.name}) for i, f in enumerate(self.fields, 1)])

    def up_project(self, df: DataFrame) -> DataFrame:
        """df with this table's fields: those that older rows lack are null or their default."""
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(f.default)).cast(f.kind.spark).alias(f.name) for f in self.fields])


def describe(df: DataFrame, name: str) -> DataFrame:
    """The schema as rows: table, position, column, type, nullable."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")
