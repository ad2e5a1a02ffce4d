"""URL rules behind a blocked Bloom filter, with an exact hash join after it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import ascii_lower, written

#: Longs in a block of the filter; a key sets one bit in each.
LANES = 4
#: Largest filter that is broadcast, in bytes.
MOST_BYTES = 16 << 20
#: Marks a key that is a rule's host alone.
HOST = "\n"
#: Seeds of Spark's xxhash64(key) and of xxhash64(7, key).
SEED = 42
SECOND = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), seed=SEED)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class BlockedBloom:
    """Bloom filter whose keys each touch one block of LANES longs.

    It takes bits_per_key bits a key, rounded up to whole blocks, and at most most_bytes; a list
    too long for that only raises the share of false positives, which the exact join removes.
    It is built as one row a block and held as one array.
    """

    def __init__(self, keys: DataFrame, column: str, bits_per_key: int = 16, most_bytes: int = MOST_BYTES):
        n = keys.count()
        self.blocks = max(1, min(most_bytes // (8 * LANES), ceil(n * bits_per_key / (64 * LANES))))
        self.words = np.zeros((self.blocks, LANES), np.uint64)
        key = F.col(column)
        block = F.pmod(F.shiftrightunsigned(F.xxhash64(key), 1), F.lit(self.blocks)).cast("int").alias("block")
        bit = lambda i: F.shiftright(F.xxhash64(F.lit(7), key), 6 * i).bitwiseAND(63).cast("int")
        lanes = [f"w{i}" for i in range(LANES)]
        set_bits = keys.select(block, *(F.call_function("shiftleft", F.lit(1).cast("long"), bit(i)).alias(w) for i, w in enumerate(lanes)))
        found = set_bits.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in lanes)).toPandas()
        self.words[found["block"].to_numpy(np.int64)] = found[lanes].to_numpy(np.int64).view(np.uint64)

    def may_contain(self, key: str) -> bool:
        raw = key.encode("utf-8", "surrogatepass")
        words = self.words[(xxhash.xxh64_intdigest(raw, seed=SEED) >> 1) % self.blocks]
        bits = xxhash.xxh64_intdigest(raw, seed=SECOND)
        return all(int(w) >> (bits >> 6 * i & 63) & 1 for i, w in enumerate(words))


class Candidates:
    """The rules that may fit a url: suffixes of its host whose own key passes the filter, with prefixes of its path.

    chars: the lengths of rule paths by the number of labels of their host.
    """

    def __init__(self, bloom: BlockedBloom, chars: dict[int, list[int]]):
        self.bloom, self.chars = bloom, chars

    def of(self, host: str, path: str) -> list[str]:
        out, labels = [], host.split(".")
        for n in range(1, len(labels) + 1):
            suffix = ".".join(labels[-n:])
            if n in self.chars and self.bloom.may_contain(HOST + suffix):
                keys = (suffix + path[:c] for c in self.chars[n] if c <= len(path))
                out += [k for k in keys if self.bloom.may_contain(k)]
        return out


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = 1 << 20, bits_per_key: int = 16, filter_bytes: int = MOST_BYTES) -> DataFrame:
    """Give every page the verdict of the longest rule that fits its url, else the default.

    rules: host, path, verdict. A rule fits its host and all subdomains where the url's path
    starts with the rule's path. Suffixes of the url's host that the filter passes, joined with
    prefixes of its path in the lengths that rules have, are its candidate keys; the filter
    passes the few that may be listed, and a hash join with the rules decides. Returns key,
    host, path, rule (host and path joined), verdict.

    Null urls and urls without :// have empty host and path and take the default; urls may be of
    any length. Repeated pages keep their number and null keys stay, ties between equal rules go
    to "allow" before "block", an empty table gives no rows, and further columns of pages are
    ignored. Rules are broadcast while their counted number is at most broadcast_rules, and
    shuffled beyond.
    """
    spark = pages.sparkSession
    rules = written(
        rules.filter("host IS NOT NULL AND path IS NOT NULL").select(F.concat("host", "path").alias("rule"), "host", "path", "verdict")
        .groupBy("rule").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.min("verdict").alias("rule_verdict")),
        "url-rules",
    )
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    chars: dict[int, list[int]] = {}
    for row in rules.select(labels.alias("labels"), F.length("path").alias("chars")).distinct().collect():  # a pair of small numbers
        chars.setdefault(row["labels"], []).append(row["chars"])
    keys = rules.select("rule").unionByName(rules.select(F.concat(F.lit(HOST), "host").alias("rule")).distinct())
    shared = spark.sparkContext.broadcast(Candidates(BlockedBloom(keys, "rule", bits_per_key, filter_bytes), chars))

    def possible(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([shared.value.of(h, p) for h, p in zip(hosts, paths)], dtype=object)

    keyed = pages.select(F.col(key).alias("page_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = written(keyed.withColumn("possible", F.pandas_udf(possible, "array<string>")("host", "path")), "url-candidates")
    missed = keyed.filter(F.size("possible") == 0).select("page_key", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Equal pages meet before the join, so a page repeated without end is one row of it.
    hit = keyed.filter(F.size("possible") > 0).groupBy("page_key", "host", "path").agg(F.first("possible").alias("possible"), F.count("*").alias("copies"))
    listed = rules.select("rule", "rule_verdict")
    if rules.count() <= broadcast_rules:
        listed = F.broadcast(listed)
    best = (
        hit.select("page_key", "host", "path", "copies", F.explode("possible").alias("rule"))
        .join(listed, "rule", "left")
        .groupBy("page_key", "host", "path", "copies")
        .agg(F.max(F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("rule").alias("chars"), "rule", "rule_verdict"))).alias("best"))
        .select("page_key", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        .drop("copy")
    )
    return missed.unionByName(best).withColumnRenamed("page_key", key)


#: Fixed rules of the query: host, path, verdict.
RULES: Sequence[tuple[str, str, str]] = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

ORACLE = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
n AS (SELECT row_number() OVER () AS i, * FROM p),
b AS (SELECT i, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS verdict
      FROM n JOIN r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p) GROUP BY i)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM n LEFT JOIN b USING (i)
"""
