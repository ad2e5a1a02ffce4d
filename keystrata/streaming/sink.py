"""Structured Streaming into a store: one micro-batch is one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.store import Store


def write_stream(stream: DataFrame, store: Store, query: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts writing user_key, value (and deleted, ord) rows.

    A batch that was committed before a failure is known by (query, number) from the manifest
    and skipped when it comes again, so every batch counts once.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.write_df(batch, (query, number))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_by_key(stream: DataFrame) -> DataFrame:
    """The newest version of each key so far, as a streaming aggregate: late, lower seqs never override."""
    return stream.groupBy("user_key").agg(F.max_by(F.struct("seq", "value", "deleted"), "seq").alias("newest")).select("user_key", "newest.*")
