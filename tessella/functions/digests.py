"""SHA-256 and HMAC-SHA-256 of columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "0123456789ABCDEF"


def canonical(value: Column, kind: str) -> Column:
    """The bytes that are hashed: text and binary as they are, integers as 16 bytes little-endian, null as nothing."""
    if kind in ("string", "binary"):
        return F.coalesce(value.cast("binary"), F.lit(b""))
    low = F.reverse(F.split(F.regexp_replace(F.lpad(F.hex(value.cast("long")), 16, "0"), "(..)", "$1 "), " "))
    sign = F.when(value < 0, F.lit("F" * 16)).otherwise(F.lit("0" * 16))
    return F.coalesce(F.unhex(F.concat(F.array_join(low, ""), sign)), F.lit(b""))


def sha256(value: Column, kind: str = "string") -> Column:
    return F.unhex(F.sha2(canonical(value, kind), 256))


def _xored(block: Column, byte: int) -> Column:
    """A block in hexadecimal, each byte XORed with one: digit by digit."""
    high, low = ("".join(_DIGITS[i ^ x] for i in range(16)) for x in (byte >> 4, byte & 15))
    pairs = F.split(F.regexp_replace(block, "(..)(?=.)", "$1 "), " ")
    return F.unhex(F.array_join(F.transform(pairs, lambda p: F.concat(F.translate(F.substring(p, 1, 1), _DIGITS, high), F.translate(F.substring(p, 2, 1), _DIGITS, low))), ""))


def hmac256(key: Column, message: Column, key_kind: str = "string", kind: str = "string") -> Column:
    """HMAC-SHA-256 as its definition has it: keys of over 64 bytes are hashed first, shorter ones padded by zeros."""
    raw, body = canonical(key, key_kind), canonical(message, kind)
    block = F.rpad(F.hex(F.when(F.octet_length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)), 128, "0")
    inner = F.unhex(F.sha2(F.concat(_xored(block, 0x36), body), 256))
    return F.unhex(F.sha2(F.concat(_xored(block, 0x5C), inner), 256))
