"""SHA-256 digests and big-endian fields as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF_PREFIX = "00"
NODE_PREFIX = "01"
KEY_PREFIX = "02"
HASH_BYTES = 32


def binary(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def utf8(column: Column) -> Column:
    return column.cast("string").cast("binary")


def digest(*parts: Column) -> Column:
    """32-byte SHA-256 over the concatenated binary parts."""
    joined = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.unhex(F.sha2(joined, 256))


def hex_text(column: Column) -> Column:
    return F.lower(F.hex(column))


def leaf_hash(record: Column) -> Column:
    return digest(binary(LEAF_PREFIX), record)


def node_hash(left: Column, right: Column) -> Column:
    return digest(binary(NODE_PREFIX), left, right)


def file_leaf(path: Column, content_hash: Column) -> Column:
    """Leaf of one file in a file set: prefix, path, separator, content hash."""
    return digest(binary(LEAF_PREFIX), utf8(path), binary("1f"), content_hash)


def big_endian(value: Column, width: int) -> Column:
    """Unsigned big-endian bytes of an integer column; null where it does not fit."""
    value = value.cast("bigint")
    fits = value >= 0
    if width < 8:
        fits = fits & (value < 2 ** (8 * width))
    return F.when(fits, F.unhex(F.lpad(F.hex(value), 2 * width, "0")))


def read_big_endian(record: Column, start: int, width: int) -> Column:
    """Integer at 0-based byte `start`; null for 8 bytes that hold 2^63 or more."""
    return F.conv(F.hex(F.substring(record, start + 1, width)), 16, 10).try_cast("bigint")


def unsigned_big_endian(value: Column) -> Column:
    """8 bytes of an integer up to 2^64 - 1 given as bigint, decimal or digits; null where it does not fit."""
    number = value.try_cast("decimal(38,0)")
    return F.when(
        (number >= 0) & (number < F.lit(str(2**64)).cast("decimal(38,0)")), F.unhex(F.lpad(F.conv(number.cast("string"), 10, 16), 16, "0"))
    )


def read_unsigned(record: Column, start: int) -> Column:
    """The 8 bytes at 0-based `start` as decimal(20,0)."""
    return F.conv(F.hex(F.substring(record, start + 1, 8)), 16, 10).cast("decimal(20,0)")


def consent_key(record: Column) -> Column:
    return digest(binary(KEY_PREFIX), record)


def consent_commitment(record: Column, salt: Column) -> Column:
    return digest(record, salt)


def revocation_value(record: Column) -> Column:
    return digest(record, utf8(F.lit("revoked")))
