"""Column functions over keys, values and entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a length or checksum field in the framed layout.
FIELD = 8


def fixed_width_key(number: Column, prefix: str = "key", width: int = 13) -> Column:
    """Zero-padded decimal keys, so that byte order is number order."""
    return F.format_string(f"{prefix}%0{width}d", number).cast("binary")


def encode_text(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def decode_text(value: Column) -> Column:
    return F.decode(value, "UTF-8")


def big_endian(number: Column) -> Column:
    """A long as 8 big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def from_big_endian(raw: Column) -> Column:
    """The non-negative long in 8 big-endian bytes."""
    return F.conv(F.hex(raw), 16, 10).cast("long")


def encode_internal_key(user_key: Column, seq: Column) -> Column:
    return F.concat(big_endian(seq), user_key)


def internal_seq(internal_key: Column) -> Column:
    return from_big_endian(F.substring(internal_key, 1, FIELD))


def internal_user_key(internal_key: Column) -> Column:
    return F.substring(internal_key, FIELD + 1, 1 << 30)


def checksum(raw: Column) -> Column:
    return F.crc32(raw)


def entry_bytes(user_key: Column, value: Column) -> Column:
    """Bytes of key and value in memory."""
    return (F.octet_length(user_key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def encoded_entry_bytes(user_key: Column, value: Column, deleted: Column) -> Column:
    """Bytes of a framed entry: key with its seq and two fields, value with two or a tombstone's one."""
    key = F.octet_length(user_key) + 3 * FIELD
    return (key + F.when(deleted, F.lit(FIELD)).otherwise(F.coalesce(F.octet_length(value), F.lit(0)) + 2 * FIELD)).cast("long")


def level_capacity(level: Column, base: int, multiplier: int) -> Column:
    return F.lit(float(base)) * F.pow(F.lit(float(multiplier)), (level - 1).cast("double"))


def spread(thread: Column, turn: Column, n: int) -> Column:
    """Key numbers that different readers visit in different orders."""
    return ((thread + 1) * (turn + 1) * 7919) % n
