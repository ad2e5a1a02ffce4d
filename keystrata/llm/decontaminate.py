"""Benchmark passages in documents by winnowed fingerprints, in DataFrame operations only.

Fingerprints are the least k-gram hash in each run of `span` neighbouring k-grams, so any shared
passage of k + span - 1 words (the window) shares one. Documents that share a fingerprint with
a benchmark item are compared with its windows word by word.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import LOWER, UPPER, ascii_lower, written

#: What stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most rows of a benchmark table that is broadcast; larger ones are shuffled.
MOST_BROADCAST = 1 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _starts(n: Column, width: int) -> Column:
    """0 to n - width, or nothing."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def grams(words: Column, width: int) -> Column:
    """Hashes of the runs of `width` words."""
    return F.transform(_starts(F.size(words), width), lambda s: F.xxhash64(*(F.get(words, s + i) for i in range(width))))


def fingerprints(words: Column, k: int, span: int) -> Column:
    """Distinct least hashes of the runs of `span` k-grams."""
    least = lambda g: F.transform(_starts(F.size(g), span), lambda s: F.least(*(F.get(g, s + i) for i in range(span))))
    return F.array_distinct(let(grams(words, k), least))


def windows_of(words: Column, width: int) -> Column:
    """start, words of each run of `width` words."""
    return F.transform(_starts(F.size(words), width), lambda s: F.struct(s.alias("start"), F.array_join(F.slice(words, s + 1, width), " ").alias("window")))


def _tagged(marks: Column, width: int) -> Column:
    return F.transform(marks, lambda h: F.struct(F.lit(width).alias("width"), h.alias("mark")))


def _spans(words: Column, width: int) -> Column:
    return F.transform(windows_of(words, width), lambda x: F.struct(F.lit(width).alias("width"), x["start"].alias("start"), x["window"].alias("window")))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def occurrences(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 8, k: int = 5) -> DataFrame:
    """doc_key, content (a hash of the text), n_hit, items and full_items of the documents with a hit.

    See benchmark_hits(), which has a row for every document.
    """
    span = window - k + 1
    parts = items.select(F.col(item).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    parts = written(parts, "benchmark-words")
    widths = sorted(r[0] for r in parts.select(F.least(F.size("words"), F.lit(window))).distinct().collect())
    listed = written(
        reduce(DataFrame.unionByName, (
            parts.filter(F.size("words") >= w if w == window else F.size("words") == w)
            .select("item", F.lit(w).alias("width"), F.explode(windows_of(F.col("words"), w)["window"]).alias("window")).distinct()
            for w in widths or [window]
        )),
        "benchmark-windows",
    )
    marks = [(w, (lambda c, w=w: fingerprints(c, k, span)) if w == window else (lambda c, w=w: F.array_distinct(grams(c, w)))) for w in widths]
    source = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("text"))
    identity = F.xxhash64("text").alias("content")
    none = F.array().cast("array<string>")
    if not marks:
        return source.select("doc_key", identity, F.lit(0).cast("long").alias("n_hit"), none.alias("items"), none.alias("full_items")).limit(0)
    tagged = lambda words: F.concat(*(_tagged(f(words), w) for w, f in marks))
    known = _bounded(written(
        reduce(DataFrame.unionByName, (parts.filter(F.size("words") >= w if w == window else F.size("words") == w).select(F.lit(w).alias("width"), F.explode(f(F.col("words"))).alias("mark")) for w, f in marks)).distinct(),
        "benchmark-marks",
    ))
    met = (
        source.filter("text IS NOT NULL")
        .select("doc_key", identity, F.explode(let(words_of(F.col("text")), tagged)).alias("m"))
        .select("doc_key", "content", F.col("m.width").alias("width"), F.col("m.mark").alias("mark"))
        .join(known, ["width", "mark"], "left_semi").select("doc_key", "content").distinct()
    )
    met = written(met, "benchmark-met")
    same = lambda a, b: a["doc_key"].eqNullSafe(b["doc_key"]) & (a["content"] == b["content"])
    suspect = source.withColumn("content", F.xxhash64("text"))
    suspect = suspect.join(met, same(suspect, met), "left_semi")
    spans = lambda words: F.concat(*(_spans(words, w) for w in widths))
    hits = (
        suspect.select("doc_key", "content", F.explode(let(words_of(F.col("text")), spans)).alias("x"))
        .select("doc_key", "content", F.col("x.width").alias("width"), F.col("x.start").alias("start"), F.col("x.window").alias("window"))
        .join(_bounded(listed), ["width", "window"])
        .groupBy("doc_key", "content")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end")))).alias("spans"),
            F.sort_array(F.collect_set("item")).alias("items"),
            F.sort_array(F.collect_set(F.when(F.col("width") == window, F.col("item")))).alias("full_items"),
        )
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["reach"], x["start"]))).alias("n"), F.greatest(a["reach"], x["end"]).alias("reach")),
        lambda a: a["n"].cast("long"),
    )
    return hits.select("doc_key", "content", covered.alias("n_hit"), "items", "full_items")


def benchmark_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 8, k: int = 5) -> DataFrame:
    """Every document's words that lie in an occurrence of a benchmark window.

    Words are runs of 0-9, a-z and non-ASCII characters once A-Z are lower-cased. An item's
    windows are its runs of `window` words; an item with fewer words is one window. Returns
    key, n_words, n_hit (words inside occurrences), items (ids as strings, sorted) and
    full_items (those of them with an occurring window of full length).

    Null texts have no words, and items without words match nothing. Rows that repeat a key are
    judged each by its text; null keys are kept; texts may be of any length. An empty documents
    table gives no rows, and an empty benchmark hits nothing. Further columns are ignored.
    """
    counted = docs.select(F.col(key).alias("doc_key"), F.xxhash64(text).alias("content"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    hits = occurrences(docs, items, key, text, item, item_text, window, k)
    none = F.array().cast("array<string>")
    return counted.join(hits, counted["doc_key"].eqNullSafe(hits["doc_key"]) & (counted["content"] == hits["content"]), "left").select(
        counted["doc_key"].alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("full_items", none).alias("full_items"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS varchar) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS x
       FROM (SELECT item, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, s, item FROM dw JOIN iw USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
