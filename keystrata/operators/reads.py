"""Reads of a versioned table at a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.schema import prefix_end, to_binary


def as_of(v: DataFrame, seq: int | None) -> DataFrame:
    """Versions visible at a snapshot, which includes its own seq; all of them if seq is None."""
    return v if seq is None else v.filter(F.col("seq") <= F.lit(seq))


def newest_per_key(v: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included.

    A partial aggregate keeps one row a key and task before the shuffle, so a key with a third
    of all versions costs no more than any other.
    """
    return v.groupBy("user_key").agg(F.max_by(F.struct("seq", "value", "deleted"), "seq").alias("newest")).select("user_key", "newest.*")


def live(v: DataFrame) -> DataFrame:
    return v.filter(~F.col("deleted"))


def snapshot(v: DataFrame, seq: int | None = None) -> DataFrame:
    """Live keys at a snapshot. The bound comes before the newest version, tombstones go after it."""
    return live(newest_per_key(as_of(v, seq))).select("user_key", "seq", "value")


def between(v: DataFrame, low: bytes | str, high: bytes | str | None) -> DataFrame:
    """Keys in [low, high), in unsigned byte order; high None: no bound."""
    from_low = v.filter(F.col("user_key") >= to_binary(low))
    return from_low if high is None else from_low.filter(F.col("user_key") < to_binary(high))


def select(v: DataFrame, key: bytes | str, seq: int | None = None) -> DataFrame:
    """The live value of one key, or no row."""
    return snapshot(v.filter(F.col("user_key") == to_binary(key)), seq)


def scan(v: DataFrame, low: bytes | str, high: bytes | str | None, seq: int | None = None) -> DataFrame:
    """Live keys of [low, high), ascending."""
    return snapshot(between(v, low, high), seq).select("user_key", "value").orderBy("user_key")


def prefix_scan(v: DataFrame, prefix: bytes | str, seq: int | None = None) -> DataFrame:
    raw = prefix.encode() if isinstance(prefix, str) else prefix
    return scan(v, raw, prefix_end(raw), seq)


def multi_get(v: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """user_key, value, found for every asked key: one join in place of many point reads.

    Versions of keys that nobody asked for go before the newest version is looked for.
    """
    asked = keys.select("user_key").distinct()
    held = snapshot(v.join(asked, "user_key", "left_semi"), seq)
    found = held.select("user_key", "value", F.lit(True).alias("found"))
    return asked.join(found, "user_key", "left").select("user_key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def latest_seq(v: DataFrame) -> DataFrame:
    return v.groupBy("user_key").agg(F.max("seq").alias("seq"))


def changes_between(v: DataFrame, after: int, until: int) -> DataFrame:
    """The newest version of every key written in (after, until], tombstones included."""
    return newest_per_key(v.filter((F.col("seq") > after) & (F.col("seq") <= until)))


def ordered_dump(v: DataFrame) -> DataFrame:
    """All versions in entry order: key ascending, newest first."""
    return v.orderBy("user_key", F.desc("seq"))


def version_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("user_key").agg(F.count("*").alias("versions"))


def ranked(v: DataFrame) -> DataFrame:
    """Each version with its rank in its key, from 1 for the newest.

    A key's versions meet in one task; a read that needs only the newest takes newest_per_key().
    """
    w = Window.partitionBy("user_key").orderBy(F.desc("seq"))
    return v.withColumn("rank", F.row_number().over(w).cast("long"))


def validity(v: DataFrame) -> DataFrame:
    """Each version with the seq that ends it (null: still the newest)."""
    w = Window.partitionBy("user_key").orderBy("seq")
    return v.withColumn("until_seq", F.lead("seq").over(w))
