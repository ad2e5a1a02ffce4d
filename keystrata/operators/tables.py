"""Operators over run metadata: ranges, levels, edits, floors."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import entry_bytes, level_capacity
from keystrata.schema import to_binary
from keystrata.storage import written

#: Most cut keys that spread a range join.
MOST_CUTS = 255
#: Most first keys that a floor join broadcasts.
MOST_LOCAL = 1 << 18
#: Bytes that a key range holds about at most, and what a row takes in a sort beside its key and value.
RANGE_BYTES, ROW_BYTES = 32 << 20, 64


def run_stats(v: DataFrame, *by: str) -> DataFrame:
    """Key range, largest and least seq, rows and bytes of each run."""
    return v.groupBy(*by).agg(
        F.min("user_key").alias("head_key"), F.max("user_key").alias("tail_key"), F.max("seq").alias("max_seq"), F.min("seq").alias("min_seq"),
        F.count("*").alias("n_rows"), F.sum(entry_bytes(F.col("user_key"), F.col("value"))).alias("size"),
    )


def pruned(runs: DataFrame, low: bytes | str, high: bytes | str) -> DataFrame:
    """Runs that may hold keys of [low, high)."""
    return runs.filter((F.col("head_key") < to_binary(high)) & (F.col("tail_key") >= to_binary(low)))


def cut_keys(df: DataFrame, column: str, cuts: int = MOST_CUTS) -> list[bytes]:
    """At most `cuts` keys of the column that split it evenly, by a range partitioning's sizes."""
    parts = df.select(column).filter(F.col(column).isNotNull()).repartitionByRange(cuts + 1, column)
    heads = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.min(column).alias("key"))
    return sorted(bytes(r["key"]) for r in heads.collect())


def _bin(key: Column, cuts: list[bytes]) -> Column:
    """How many cuts are at or below the key."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*(to_binary(c) for c in cuts)), lambda c: c <= key))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of runs whose closed key ranges meet, as a_id and b_id.

    Cut keys split the key space; a run stands in every part it reaches, parts meet by an
    equi-join, and a pair counts only in the part where the later of its two heads lies.
    """
    cuts = cut_keys(a.select("head_key").unionByName(b.select("head_key")), "head_key")

    def parts(runs: DataFrame, name: str) -> DataFrame:
        first, last = _bin(F.col("head_key"), cuts), _bin(F.col("tail_key"), cuts)
        return runs.select(
            F.col("table_id").alias(f"{name}_id"), F.col("head_key").alias(f"{name}_head"), F.col("tail_key").alias(f"{name}_tail"),
            first.alias(f"{name}_first"), F.explode(F.sequence(first, last)).alias("part"),
        )

    return (
        parts(a, "a").join(parts(b, "b"), "part")
        .filter((F.col("a_head") <= F.col("b_tail")) & (F.col("b_head") <= F.col("a_tail")) & (F.col("part") == F.greatest("a_first", "b_first")))
        .select("a_id", "b_id")
    )


def floor_block(index: DataFrame, keys: DataFrame, most_local: int = MOST_LOCAL, part_rows: int = 1 << 20) -> DataFrame:
    """The block of each key: the last one whose first key is at or below it, else the first block.

    index: first_key, block; of blocks with one first key the first counts. An index of at most
    most_local rows, counted first, is broadcast and searched; the keys aren't shuffled at all.
    Beyond it keys, equal ones as one row, and first keys are sorted together by range, in parts
    of about part_rows rows; a part's first keys carry on to the parts after it, so no task
    depends on how many keys fall into a block. Null keys have the first block.
    """
    spark = index.sparkSession
    starts = written(index.groupBy(F.col("first_key").alias("user_key")).agg(F.min("block").cast("long").alias("block")), "floor-index")
    n = starts.count()
    if n <= most_local:
        rows = starts.orderBy("user_key").collect()
        held = spark.sparkContext.broadcast(([bytes(r["user_key"]) for r in rows], [r["block"] for r in rows]))

        def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first, block = held.value
            for frame in frames:
                place = (max(0, bisect_right(first, k) - 1) if k is not None and first else 0 for k in frame["user_key"])
                yield frame.assign(block=pd.array([block[i] if block else None for i in place], dtype="Int64"))

        return keys.select("user_key").mapInPandas(found, "user_key binary, block long")
    asked = keys.groupBy("user_key").agg(F.count("*").alias("times"))
    both = asked.select("user_key", F.lit(None).cast("long").alias("block"), "times").unionByName(starts.select("user_key", "block", F.lit(0).cast("long").alias("times")))
    parts = max(1, -(-(n + asked.count()) // part_rows))
    both = written(both.repartitionByRange(parts, "user_key").withColumn("part", F.spark_partition_id()), "floor-parts")
    last = both.filter("block IS NOT NULL").groupBy("part").agg(F.max_by("block", "user_key").alias("last"))
    # One row a part: what the parts before it hand on, and the first block for keys below all.
    every = both.select("part").distinct().join(last, "part", "left").withColumn("carried", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    first = starts.agg(F.min_by("block", "user_key")).first()[0]
    w = Window.partitionBy("part").orderBy("user_key", "times").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("floor", F.last("block", True).over(w)).filter("times > 0").join(F.broadcast(every.select("part", "carried")), "part")
        .select("user_key", F.coalesce("floor", "carried", F.lit(first).cast("long")).alias("block"), F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        .select("user_key", "block")
    )


def level_scores(runs: DataFrame, trigger: int, base: int, multiplier: int) -> DataFrame:
    """level, tables, bytes, score: tables against the trigger in level 0, bytes against capacity below."""
    score = F.when(F.col("level") == 0, F.col("tables") / F.lit(float(trigger))).otherwise(F.col("bytes") / level_capacity(F.col("level"), base, multiplier))
    return runs.groupBy("level").agg(F.count("*").alias("tables"), F.sum("size").alias("bytes")).withColumn("score", score)


def chosen_level(scores: DataFrame) -> DataFrame:
    """The level of the largest score of at least 1; of equal ones the deepest."""
    return scores.filter("score >= 1").orderBy(F.desc("score"), F.desc("level")).limit(1).select("level")


def deepest_level(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"))


def level_range(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(F.min("head_key").alias("head_key"), F.max("tail_key").alias("tail_key"))


def round_robin(runs: DataFrame, pointer: bytes | None) -> DataFrame:
    """The run after the pointer, or the first one."""
    after = F.lit(True) if pointer is None else F.col("head_key") > to_binary(pointer)
    return runs.withColumn("after", after).orderBy(F.desc("after"), "head_key", "table_id").limit(1).drop("after")


def read_order(runs: DataFrame) -> DataFrame:
    """select_rank: level 0 newest first, then deeper levels; scan_rank is its reverse by level."""
    newest = F.when(F.col("level") == 0, -F.col("table_id")).otherwise(F.col("table_id"))
    deepest = Window.orderBy(F.desc("level"), "table_id")
    return runs.select(
        "table_id", "level", F.row_number().over(Window.orderBy("level", newest)).cast("long").alias("select_rank"),
        F.row_number().over(deepest).cast("long").alias("scan_rank"),
    )


def apply_edits(runs: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """The table set after edits. Ids are never used again, so the order of the edits is free."""
    return runs.unionByName(added).join(deleted.select("table_id"), "table_id", "left_anti").select(*runs.columns)


def orphans(on_disk: DataFrame, referenced: DataFrame) -> DataFrame:
    return on_disk.select("table_id").distinct().join(referenced.select("table_id"), "table_id", "left_anti")


def next_table_id(runs: DataFrame) -> DataFrame:
    return runs.agg((F.coalesce(F.max("table_id"), F.lit(-1)) + 1).cast("long").alias("next_id"))


def key_ranges(v: DataFrame, parts: int, range_bytes: int | None = RANGE_BYTES) -> DataFrame:
    """Versions dealt into key ranges for new runs, each in entry order; a key never splits.

    A task sorts a whole range, so there are more than `parts` ranges where these would hold more
    than range_bytes each; keys and values of all rows are weighed first. With None the caller has
    weighed them. A key's versions are one range however many they are.
    """
    if range_bytes is not None:
        weight = v.agg(F.sum(entry_bytes(F.col("user_key"), F.col("value")) + ROW_BYTES)).first()[0] or 0
        parts = max(parts, -(-weight // range_bytes))
    return v.repartitionByRange(max(1, parts), "user_key").sortWithinPartitions("user_key", F.desc("seq"))
