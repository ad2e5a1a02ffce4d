"""Unions and precedence merges of versioned sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.operators.reads import latest_seq, snapshot


def union_all(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def merged_snapshot(*sources: DataFrame, seq: int | None = None) -> DataFrame:
    """Live keys over several sources. Seqs are global, so precedence is the larger seq."""
    return snapshot(union_all(*sources), seq)


def merge_precedence(high: DataFrame, low: DataFrame) -> DataFrame:
    """One row a key; high's rows replace low's even where they are tombstones."""
    return high.unionByName(low.join(high.select("user_key"), "user_key", "left_anti"))


def merged_latest_seq(*sources: DataFrame) -> DataFrame:
    """The largest seq of each key over all sources, each reduced before it is shuffled."""
    return latest_seq(union_all(*sources))


def fold_write_set(writes: DataFrame, *by: str) -> DataFrame:
    """The last write, by `ord`, of each key in each transaction (the columns of `by`)."""
    return (
        writes.groupBy(*by, "user_key").agg(F.max_by(F.struct("value", "deleted"), "ord").alias("last"))
        .select(*by, "user_key", "last.*")
    )


def overlay(base: DataFrame, write_set: DataFrame) -> DataFrame:
    """Live user_key, value of a snapshot under a transaction's own folded writes."""
    own = write_set.select("user_key", "value", "deleted")
    under = base.select("user_key", "value", F.lit(False).alias("deleted"))
    return merge_precedence(own, under).filter(~F.col("deleted")).select("user_key", "value")


def apply_batch(held: DataFrame, batch: DataFrame) -> DataFrame:
    """held and a later batch; of rows with one (key, seq) the later arrival stays."""
    w = Window.partitionBy("user_key", "seq").orderBy(F.desc("arrival"))
    both = held.withColumn("arrival", F.lit(0)).unionByName(batch.withColumn("arrival", F.lit(1)))
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "arrival")
