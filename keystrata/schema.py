"""The versioned table: one row for each write of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONED = T.StructType([
    T.StructField("user_key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("deleted", T.BooleanType(), False),
])
COLUMNS = VERSIONED.fieldNames()

#: Rows of the manifest: one immutable sorted run each.
RUN = "table_id long, level int, head_key binary, tail_key binary, size long, n_rows long, max_seq long"


def to_binary(key: bytes | str | Column) -> Column:
    """A key as a binary column; strings are UTF-8."""
    if isinstance(key, Column):
        return key.cast("binary")
    return F.lit(bytearray(key.encode() if isinstance(key, str) else key))


def versioned(df: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """A table with text keys and values as a versioned one."""
    return df.select(
        F.col(key).cast("binary").alias("user_key"), F.col("seq").cast("long").alias("seq"),
        F.col(value).cast("binary").alias("value"), F.col("deleted").alias("deleted"),
    )


def readable(df: DataFrame) -> DataFrame:
    """user_key and value as text columns k and v."""
    names = {"user_key": "k", "value": "v"}
    return df.select(*(F.col(c).cast("string").alias(names[c]) if c in names else F.col(c) for c in df.columns))


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above every key that starts with prefix; None if there is none."""
    stripped = prefix.rstrip(b"\xff")
    return stripped[:-1] + bytes([stripped[-1] + 1]) if stripped else None
