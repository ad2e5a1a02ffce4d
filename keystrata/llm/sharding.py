"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.shared import written


def differencing(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each item.

    Each item starts as a partial partition with all its bytes in one part. The two partial
    partitions of largest spread are combined again and again, largest part with smallest,
    until one is left. Ties go to the earlier partition.
    """
    heap: list = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(0, None)] * (shards - 1) + [(size, i)]))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        parts = sorted(((x + y, (m, n) if m is not None and n is not None else m if n is None else n) for (x, m), (y, n) in zip(a, reversed(b))), key=lambda p: p[0])
        heapq.heappush(heap, (parts[0][0] - parts[-1][0], order, parts))
        order += 1
    shard_of = [0] * len(sizes)
    for shard, (_, node) in enumerate(heap[0][2] if heap else []):
        stack = [] if node is None else [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                shard_of[x] = shard
    return shard_of


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", bundles: int = 8192, heavy_per_shard: int = 512) -> DataFrame:
    """Deal all documents into shards of near-equal bytes; equal texts stay together.

    A document weighs the UTF-8 bytes of its text plus 1. Groups of at least
    1 / (shards * heavy_per_shard) of all bytes are items of their own (so at most
    shards * heavy_per_shard of them); the others are first bundled by hash into at most
    `bundles` items. Differencing then runs over these items, whose number doesn't grow with
    the input. Returns key, size, text_crc32 (unsigned), shard, slot (gapless from 0 in a
    shard, in key order within a partition).

    Null texts weigh 1, have crc32 0 and form one group. Repeated rows and keys are dealt out
    as rows of their own, an empty table gives no rows, and further columns are ignored.
    """
    content = F.col(text).cast("binary")
    narrow = written(
        docs.select(
            F.col(key).alias("doc_key"),
            (F.coalesce(F.octet_length(content), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(content), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(content, 256), F.lit("null")).alias("content"),
        ),
        "sharding-rows",
    )
    total = narrow.agg(F.sum("size")).first()[0] or 0
    least = max(1, -(-total // (shards * heavy_per_shard)))
    bundle = F.pmod(F.xxhash64("content"), F.lit(bundles)).cast("int")
    heavy = F.col("bytes") >= least
    items = (
        narrow.groupBy("content").agg(F.sum("size").alias("bytes"))
        .groupBy(F.when(heavy, F.col("content")).alias("content"), F.when(~heavy, bundle).alias("bundle"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()
    )
    items.sort(key=lambda r: (-r["bytes"], r["content"] or "", r["bundle"] or 0))
    placed = differencing([r["bytes"] for r in items], shards)
    spark = docs.sparkSession
    own = spark.createDataFrame([(r["content"], s) for r, s in zip(items, placed) if r["content"] is not None], "content string, own int")
    dealt = spark.createDataFrame([(r["bundle"], s) for r, s in zip(items, placed) if r["bundle"] is not None], "bundle int, dealt int")
    # Both maps are bounded by the parameters, whatever the input.
    at = (
        narrow.withColumn("bundle", bundle)
        .join(F.broadcast(own), "content", "left")
        .join(F.broadcast(dealt), "bundle", "left")
        .select("doc_key", "size", "text_crc32", F.coalesce("own", "dealt").alias("shard"))
    )
    numbered = written(at.sortWithinPartitions("shard", "doc_key").withColumn("at", F.monotonically_increasing_id()), "sharding-order")
    part = F.shiftright("at", 33)
    counts = numbered.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = counts.select("shard", "part", (before - F.col("first")).alias("shift"))
    return (
        numbered.withColumn("part", part).join(starts, ["shard", "part"])
        .select(F.col("doc_key").alias(key), "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))
    )
