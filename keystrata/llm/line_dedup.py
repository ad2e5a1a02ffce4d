"""Repeated lines dropped over levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.shared import LOWER, UPPER, ascii_lower, new_path, written

#: Stripped at both ends of a line: [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Keys of a bucket of a run, and Spark's most buckets.
BUCKET_KEYS, MOST_BUCKETS = 1 << 20, 100_000
#: Most decisions that are broadcast to the lines.
MOST_BROADCAST = 1 << 17


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Spark takes the order of buckets that are one file each as given."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """A run in the shared folder: buckets by key, each sorted. The catalog holds it only to read it once."""
    spark, name = df.sparkSession, f"line_run_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", new_path(spark, "line-run")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


class LineRuns:
    """Runs of (h1, h2, docs), bucketed and sorted by the two halves of a line's hash.

    Batches come from the largest documents down. A batch's keys are merged with each run in
    turn, without moving or sorting the run: keys in no run (the anti-join's side) are new, and
    the batch's largest document keeps their lines; of keys in a run the batch keeps nothing;
    keys that the runs already hold in enough documents are decided and enter no run any more.
    What is left becomes the batch's own run. `fanout` runs of a level are merged into one run
    of the next.
    """

    def __init__(self, buckets: int, least_docs: int, fanout: int = 3):
        self.buckets, self.least_docs, self.fanout = buckets, least_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.judged: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in reversed(self.levels) for run in level]

    def seen(self, own: DataFrame) -> DataFrame:
        """own with `before`: the documents that the runs hold of its keys, null for new keys."""
        runs = self.runs()
        for i, run in enumerate(runs):
            own = own.join(run.select(*KEY, F.col("docs").alias(f"docs{i}")).hint("merge"), KEY, "left")
        held = [F.col(f"docs{i}") for i in range(len(runs))]
        some = F.coalesce(*held).isNotNull() if held else F.lit(False)
        total = reduce(Column.__add__, (F.coalesce(c, F.lit(0)) for c in held), F.lit(0).cast("long"))
        return own.withColumn("before", F.when(some, total)).drop(*(f"docs{i}" for i in range(len(runs))))

    def add(self, batch: DataFrame) -> None:
        """batch: doc_key, h1, h2 of the eligible lines of documents below all those added before."""
        own = (
            batch.groupBy(*KEY, "doc_key").agg(F.lit(1).alias("one"))
            .groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_key").alias("last"))
            .repartition(self.buckets, *KEY)
        )
        with sorted_buckets(batch.sparkSession):
            seen = self.seen(own)
            keeper = F.when(F.col("before").isNull(), F.col("last")).alias("keeper")
            judged = _bucketed(seen.select(*KEY, "docs", keeper, F.coalesce(F.col("before") >= self.least_docs, F.lit(False)).alias("decided")), self.buckets)
        self.judged.append(judged)
        self._put(0, judged.filter(~F.col("decided")).select(*KEY, "docs"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._compacted(full))

    def _compacted(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, merged bucket by bucket."""

        def merged(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("docs", "more").hint("merge"), KEY, "full")
            return both.select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))

        with sorted_buckets(runs[0].sparkSession):
            return _bucketed(reduce(merged, runs), self.buckets)

    def decisions(self) -> DataFrame:
        """h1, h2, batch (from 0, in order of coming) and keeper, of all keys in enough documents.

        Lines of the batch with such a key go, except in the keeper; a null keeper keeps none.
        """
        total = self.runs()
        total = self._compacted(total) if len(total) > 1 else total[0]
        enough = total.filter(F.col("docs") >= self.least_docs).select(*KEY)
        out = []
        for i, judged in enumerate(self.judged):
            late = judged.filter(~F.col("decided")).join(enough.hint("merge"), KEY, "left_semi")
            out += [x.select(*KEY, F.lit(i).alias("batch"), "keeper") for x in (judged.filter("decided"), late)]
        with sorted_buckets(total.sparkSession):
            return written(reduce(DataFrame.unionByName, out), "lines-decided")


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3, batches: int = 4, fanout: int = 3, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Every document without the lines that other documents repeat.

    A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased.
    Keys of at least least_chars code points that at least least_docs documents hold lose their
    lines everywhere but in the largest key's document, which keeps all of them. Batches of
    documents go from the largest integer key to the smallest; in each, the merge with the runs
    of the batches before says which lines are new. Decisions, at most one for each key and
    batch, are broadcast to the lines while their counted number is at most most_broadcast.
    Returns key, n_lines, n_dropped and kept (the other lines, joined by newlines).

    Null and empty texts are one empty line; texts may be of any length. Rows that repeat a key
    are one document; rows with a null key neither hold keys nor lose lines. An empty table
    gives no rows; further columns are ignored.
    """
    source = docs.select(F.col(key).alias("doc_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    stripped = ascii_lower(F.btrim(F.col("line"), F.lit(BLANK)))
    lines = (
        source.filter("doc_key IS NOT NULL")
        .select("doc_key", F.xxhash64("text").alias("content"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .filter(F.length("line") >= least_chars)
        .select("doc_key", "content", "pos", stripped.alias("line"))
        .filter(F.length("line") >= least_chars)
        .select("doc_key", "content", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )
    cuts = source.select(F.percentile_approx("doc_key", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    batch = reduce(lambda x, c: x + (F.col("doc_key") <= c).cast("int"), cuts or [], F.lit(0))
    lines = written(lines.withColumn("batch", batch), "lines", "batch")
    buckets = min(MOST_BUCKETS, max(docs.sparkSession.sparkContext.defaultParallelism, lines.count() // (batches * BUCKET_KEYS)))
    runs = LineRuns(buckets, least_docs, fanout)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i))
    decided = runs.decisions()
    decided = F.broadcast(decided) if decided.count() <= most_broadcast else decided
    gone = (
        lines.join(decided, [*KEY, "batch"]).filter("keeper IS NULL OR doc_key <> keeper")
        .groupBy("doc_key", "content").agg(F.collect_set("pos").alias("gone"))
    )
    # The lines are a column on this side of the join, so the lambda below reads it in place.
    split = source.select("doc_key", F.xxhash64("text").alias("content"), F.split("text", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return split.join(gone, ["doc_key", "content"], "left").select(
        F.col("doc_key").alias(key), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> doc_id AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
