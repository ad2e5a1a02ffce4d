"""Conflicts, garbage collection and snapshot floors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.storage import written


def conflicts(write_set: DataFrame, v: DataFrame, snapshot_seq: int) -> DataFrame:
    """Keys of a write set with a version, tombstones too, that was committed after its snapshot."""
    newer = v.filter(F.col("seq") > snapshot_seq).select("user_key")
    return write_set.join(newer, "user_key", "left_semi").select("user_key")


def transaction_conflicts(transactions: DataFrame) -> DataFrame:
    """seq, conflicted for transactions that all committed in order of seq.

    transactions: seq, snapshot_seq, user_key, folded. A transaction conflicts if one of its
    keys was last written, before it, after its snapshot.
    """
    before = F.lag("seq").over(Window.partitionBy("user_key").orderBy("seq"))
    return (
        transactions.withColumn("before", before)
        .groupBy("seq").agg(F.max(F.coalesce(F.col("before") > F.col("snapshot_seq"), F.lit(False))).alias("conflicted"))
    )


def first_committer_wins(attempts: DataFrame) -> DataFrame:
    """group, tx, committed for the attempts of the transactions of a group, all at one snapshot.

    attempts: group, tx, commit_order, user_key. In order of commit_order, a transaction
    commits unless one that committed before it wrote one of its keys; an aborted one writes
    nothing and so blocks nobody. Rounds settle it: who stands first on all of its keys
    commits, those after it on a key abort, and both leave; a round decides at least one
    transaction of each group that is left. Each round is an aggregate and a join, written to
    keep the plan short. Repeated rows count once, and rows with a null key write nothing.
    """
    spark = attempts.sparkSession
    everyone = attempts.select("group", "tx", "commit_order").distinct()
    left = written(attempts.filter("user_key IS NOT NULL").select("group", "tx", "commit_order", "user_key").distinct(), "attempts")
    aborted = []
    while not left.isEmpty():
        first = left.groupBy("group", "user_key").agg(F.min("commit_order").alias("first"))
        placed = left.join(first, ["group", "user_key"])
        state = written(placed.groupBy("group", "tx").agg(F.max(F.col("commit_order") > F.col("first")).alias("behind")), "attempts-state")
        winners = placed.join(state.filter("NOT behind"), ["group", "tx"]).select("group", "user_key").distinct()
        lost = written(left.join(winners, ["group", "user_key"]).join(state.filter("behind"), ["group", "tx"]).select("group", "tx").distinct(), "attempts-lost")
        aborted.append(lost)
        left = written(left.join(state.filter("NOT behind").select("group", "tx").unionByName(lost), ["group", "tx"], "left_anti"), "attempts")
    out = reduce(DataFrame.unionByName, aborted) if aborted else spark.createDataFrame([], attempts.select("group", "tx").schema)
    return everyone.join(out.withColumn("lost", F.lit(True)), ["group", "tx"], "left").select("group", "tx", F.col("lost").isNull().alias("committed"))


def gc_versions(v: DataFrame, floor: int, drop_tombstones: bool = False, older: int | None = None) -> DataFrame:
    """What compaction keeps: every version above the floor, and each key's newest at or below it.

    drop_tombstones, at the bottom level: that newest goes too if it is a tombstone, unless
    versions from the seq `older` on stand elsewhere, which it may still hide. Versions at or below the floor meet in a partial aggregate; those above it aren't shuffled at all.
    """
    above = v.filter(F.col("seq") > floor)
    below = (
        v.filter(F.col("seq") <= floor).groupBy("user_key")
        .agg(F.max_by(F.struct("seq", "value", "deleted"), "seq").alias("newest")).select("user_key", "newest.*")
    )
    if drop_tombstones:
        below = below.filter(~F.col("deleted") if older is None else ~F.col("deleted") | (F.col("seq") >= older))
    return above.unionByName(below.select(*above.columns))


def commit_batches(v: DataFrame, arrival: Column, window: int, limit: int) -> DataFrame:
    """window, batch, writes, first_seq, last_seq: writes that share one fsync.

    Writes that arrive in one window of time are one group, cut into batches of at most
    `limit` in order of seq. A window is one task's work, so windows stay short.
    """
    at = F.floor(arrival / window).cast("long").alias("window")
    place = F.row_number().over(Window.partitionBy("window").orderBy("seq")) - 1
    return (
        v.select(at, "seq").withColumn("batch", F.floor(place / limit).cast("long"))
        .groupBy("window", "batch").agg(F.count("*").alias("writes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    )


def gc_floor(active: DataFrame, current: int) -> DataFrame:
    """The least snapshot that is still read, or the current seq if none is older."""
    return active.agg(F.least(F.coalesce(F.min("snapshot"), F.lit(current)), F.lit(current)).cast("long").alias("floor"))


def active_counts(active: DataFrame) -> DataFrame:
    return active.groupBy("snapshot").agg(F.count("*").alias("readers"))
