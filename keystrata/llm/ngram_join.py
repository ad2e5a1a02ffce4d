"""Jaccard self-join of word shingles by T-occurrence search.

A text's set holds its distinct k-word shingles. Texts with equal sets are one class from the
start. Where two sets reach the threshold, any global order of the shingles makes their first
|set| - T + 1 shingles meet (T: the least overlap). The order used puts shingles with long
inverted lists last, so the lists that are merged are the short ones. Texts whose short lists
meet, at sizes that the threshold allows, form a unit; in each unit, DivideSkip merges the
short lists, probes the long ones for what may still reach T, and keeps exact links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.components import components, local_roots
from keystrata.llm.shared import LOWER, UPPER, give_back, giving_back, written
from keystrata.llm.words import mix, shingles, word_hashes

#: Steps of the coarse scale of set sizes within one factor of the threshold.
FINE = 3
#: Most classes in units for which they are broadcast; with more, texts and sets are shuffled to them.
MOST_BROADCAST = 1 << 20
#: A block of a large unit is an eighth of a core's part of all shingles, within these bounds.
LEAST_UNIT, MOST_UNIT = 1 << 17, 1 << 21


def least_overlap(n: int, percent: int) -> int:
    """The fewest common shingles of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def digest(marks: np.ndarray) -> int:
    """64 bits for a set of shingles, as a signed integer."""
    return int(mix(np.array([np.add.reduce(mix(marks ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], np.uint64) + np.uint64(len(marks)))[0].view(np.int64))


def _codes(n: np.ndarray, percent: int) -> np.ndarray:
    """Set sizes on a coarse scale of FINE steps for each factor of the threshold."""
    return np.minimum(255, np.log(n) / -log(min(percent, 99) / 100) * FINE).astype(np.uint8)


def merge_runs(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group entries with one key whose size ranges can meet.

    Returns the order of the entries, the first entry of each run in it, and for each place in
    the order the largest size code so far within its key.
    """
    order = np.lexsort((low, keys))
    k, lo = keys[order], low[order]
    # The furthest size reached so far within a key: sizes are raised by the key's rank.
    _, rank = np.unique(k, return_inverse=True)
    lift = rank.astype(np.int64) << 20
    reach = np.maximum.accumulate(high[order] + lift)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (lo[1:] + lift[1:] > reach[:-1] + FINE + 1)
    first = np.flatnonzero(new)
    return order, first, reach - lift


#: What buckets of the index hold: shingle (with its bucket), class, and a range of size codes.
POSTING = np.dtype([("key", "<u4"), ("name", "<i8"), ("low", "u1"), ("high", "u1")])
#: Documents of a bucket, and classes that are dealt out to buckets at once.
BUCKET_DOCS, BATCH = 4096, 2048


def held_type(buckets: int) -> np.dtype:
    """What buckets of classes hold: class, set size, a shared shingle's bucket and key, and its classes."""
    return np.dtype([("name", "<i8"), ("n", "<u4"), ("bucket", "<u2" if buckets <= 1 << 16 else "<u4"), ("key", "<u4"), ("classes", "<u2")])


def placed(marks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each shingle and 32 more bits of it; buckets is a power of two up to 2^31."""
    return (marks & np.uint64(buckets - 1)).astype(np.int64), (marks >> np.uint64(32)).astype(np.uint32)


def _sets(frame: pd.DataFrame, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The class and set of each row of texts."""
    for words in word_hashes(frame["text"]):
        marks = shingles(words, k)
        yield (digest(marks) if len(marks) else 0), marks


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the length of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    by = np.argsort(bucket, kind="stable")
    first, _ = _runs(bucket[by])
    split = [np.split(c[by], first[1:]) for c in columns]
    for i, b in enumerate(bucket[by][first]):
        yield int(b), [c[i] for c in split]


def _classes(rows: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for frame in rows:
        found = [(name, len(marks)) for name, marks in _sets(frame, k)]
        yield pd.DataFrame({"doc_key": frame["doc_key"], "content": frame["content"], "n_shingles": [n for _, n in found], "class": [c for c, _ in found]})
        del frame, found
        give_back()


def _inverted(rows: Iterator[pd.DataFrame], k: int, buckets: int) -> Iterator[pd.DataFrame]:
    """All shingles of the classes of a batch, by bucket: names and sizes, and each key's place among them."""
    for frame in rows:
        for start in range(0, len(frame), BATCH):
            sets = dict(_sets(frame.iloc[start : start + BATCH], k))
            sets.pop(0, None)
            if not sets:
                continue
            sizes = np.array([len(x) for x in sets.values()], np.uint32)
            names = np.array(list(sets), np.int64)
            bucket, key = placed(np.concatenate(list(sets.values())), buckets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            del sets
            made = [
                (b, names[used].tobytes(), sizes[used].tobytes(), keys.tobytes(), place.astype(np.uint16).tobytes())
                for b, (keys, owner) in _by_bucket(bucket, key, owner)
                for used, place in [np.unique(owner, return_inverse=True)]
            ]
            yield pd.DataFrame(made, columns=["bucket", "names", "sizes", "keys", "places"])
            del made, sizes, names, bucket, key, owner
        del frame
        give_back()


def _shared(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """The shingles of a bucket that several classes hold, dealt out by class."""
    place = [np.frombuffer(x, np.uint16) for x in frame["places"]]
    name = np.concatenate([np.frombuffer(x, np.int64)[p] for x, p in zip(frame["names"], place)])
    size = np.concatenate([np.frombuffer(x, np.uint32)[p] for x, p in zip(frame["sizes"], place)])
    key = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["keys"]])
    order = np.argsort(key, kind="stable")
    first, n = _runs(key[order])
    order = order[np.repeat(n > 1, n)]
    order = order[np.lexsort((name[order], key[order]))]
    key, name, size = key[order], name[order], size[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name, size = key[once], name[once], size[once]
    _, n = _runs(key)
    n = np.repeat(n, n)
    held = np.empty(int((n > 1).sum()), held_type(buckets))
    held["name"], held["n"], held["key"] = name[n > 1], size[n > 1], key[n > 1]
    held["bucket"], held["classes"] = frame["bucket"].iloc[0], np.minimum(n[n > 1], 65535)
    to = (mix(held["name"].view(np.uint64) if held["name"].flags.c_contiguous else held["name"].astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)
    return pd.DataFrame([(b, x.tobytes()) for b, (x,) in _by_bucket(to, held)], columns=["bucket", "payload"])


def _prefixes(frame: pd.DataFrame, percent: int, buckets: int) -> pd.DataFrame:
    """For the classes of a bucket, the shared shingles among the first of their order, dealt out by shingle.

    Shingles in one class alone come first and can meet nothing; then those in few classes.
    """
    x = np.frombuffer(b"".join(frame["payload"]), held_type(buckets))
    x = x[np.lexsort((x["key"], x["bucket"], x["classes"], x["name"]))]
    first, shared = _runs(x["name"])
    size = x["n"][first].astype(np.int64)
    take = size - -(-percent * size // 100) + 1 - (size - shared)
    rank = np.arange(len(x)) - np.repeat(first, shared)
    x = x[rank < np.repeat(take, shared)]
    code = _codes(x["n"], percent)
    packed = np.empty(len(x), POSTING)
    packed["key"], packed["name"], packed["low"], packed["high"] = x["key"], x["name"], code, code
    return pd.DataFrame([(b, p.tobytes()) for b, (p,) in _by_bucket(x["bucket"].astype(np.int64), packed)], columns=["bucket", "payload"])


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """A class that meets others in a bucket, with the smallest class it is connected with there."""
    x = np.frombuffer(b"".join(frame["payload"]), POSTING)
    order, first, _ = merge_runs(x["key"].copy(), x["low"].astype(np.int64), x["high"].astype(np.int64))
    name = x["name"][order]
    least = np.repeat(np.minimum.reduceat(name, first), np.diff(np.append(first, len(order))))
    node, root = local_roots(name[name != least], least[name != least])
    return pd.DataFrame({"a": node[node != root], "b": root[node != root]})


class Occurrences:
    """Inverted lists of some sets, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], percent: int, mu: float = 0.0085):
        self.sets, self.percent, self.mu = sets, percent, mu
        self.size = np.array([len(x) for x in sets])
        marks = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(marks, kind="stable")  # each list keeps its owners in order
        self.owner = owner[order]
        marks = marks[order]
        self.first = np.flatnonzero(np.diff(marks, prepend=~marks[:1]))
        self.marks = marks[self.first]
        self.last = np.append(self.first[1:], len(marks))

    def search(self, marks: np.ndarray) -> np.ndarray:
        """The sets that link with the given one."""
        n = len(marks)
        at = np.searchsorted(self.marks, marks)
        at[at == len(self.marks)] = 0
        at = at[self.marks[at] == marks]
        need = least_overlap(n, self.percent)
        if len(at) < need:
            return np.zeros(0, np.int64)
        lists = at[np.argsort(self.last[at] - self.first[at], kind="stable")]
        longest = int(self.last[lists[-1]] - self.first[lists[-1]])
        # The longest lists are set aside, as many as the method's estimate says; they cannot make T alone.
        aside = min(need - 1, int(need / (self.mu * log2(longest + 1) + 1))) if longest > 1 else 0
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        each = self.last[short] - self.first[short]
        merged = np.sort(self.owner[np.repeat(self.last[short] - np.cumsum(each), each) + np.arange(each.sum())], kind="stable")
        start = np.flatnonzero(np.diff(merged, prepend=-1))
        found, count = merged[start], np.diff(np.append(start, len(merged)))
        for left, i in zip(range(len(long), 0, -1), long):
            may = count >= need - left
            found, count = found[may], count[may]
            if not len(found):
                return found
            owners = self.owner[self.first[i] : self.last[i]]
            place = np.minimum(np.searchsorted(owners, found), len(owners) - 1)
            count = count + (owners[place] == found)
        return found[100 * count >= self.percent * (n + self.size[found] - count)]


def link_sets(sets: list[np.ndarray], percent: int, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that the threshold connects; only: search from these sets alone.

    Sets in the largest class need no search of their own once all others were searched.
    """
    index = Occurrences(sets, percent)
    root = np.arange(len(sets))
    todo = np.zeros(len(sets), bool)
    todo[only if only is not None else slice(None)] = True
    links = []
    size = np.bincount(root)
    while True:
        open_ = np.flatnonzero(todo & (root != np.argmax(size))) if only is None and links else np.flatnonzero(todo)
        if not len(open_):
            return links
        for i in open_:
            todo[i] = False
            others = [j for j in np.unique(root[index.search(sets[i])]) if j != root[i]]
            if others:
                links += [(int(i), int(j)) for j in others]
                root[np.isin(root, others)] = root[i]
                size = np.bincount(root, minlength=len(sets))
                break


def _unit_links(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of every unit in a frame of unit, class, marks, seeker."""
    out: list[tuple[int, int]] = []
    for _, unit in frame.groupby("unit", sort=False):
        if len(unit) > 1:
            unit = unit.sort_values("seeker", ascending=False, kind="stable").drop_duplicates("class")
            names = unit["class"].to_numpy()
            only = None if unit["seeker"].isna().any() else np.flatnonzero(unit["seeker"].to_numpy(bool))
            out += [(names[i], names[j]) for i, j in link_sets([np.frombuffer(x, np.uint64) for x in unit["marks"]], percent, only)]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _marks(rows: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    done: set[int] = set()
    for frame in rows:
        # Equal rows come together; one of them is enough.
        frame = frame.loc[~frame["class"].isin(done)].drop_duplicates(["class", "text"])
        found = [shingles(w, k) for w in word_hashes(frame["text"])]
        frame["marks"] = [x.tobytes() for x in found]
        # Two texts may have one content hash; only the row whose set is the class's counts.
        frame = frame.loc[[len(x) > 0 and digest(x) == c for x, c in zip(found, frame["class"])], ["unit", "class", "marks"]].drop_duplicates("class")
        done.update(frame["class"])
        yield frame
        del frame, found
        give_back()


def _joined(docs: DataFrame, key: str, text: str, k: int, percent: int, unit_shingles: int | None, bucket_docs: int, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """All rows as doc_key, content, n_shingles and class; and the classes with several rows or a link.

    Those have their number of rows as copies, the least class they are connected with as root,
    and as least their first row: none (whether its key is null), doc_key, content.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("content"))
    buckets = 1 << min(31, max(4, (docs.count() // bucket_docs).bit_length()))
    kind = source.schema["doc_key"].dataType.simpleString()
    rows = written(source.mapInPandas(lambda x: _classes(x, k), f"doc_key {kind}, content long, n_shingles long, class long"), "ngram-classes")
    lists = source.select("text").filter("text IS NOT NULL").mapInPandas(lambda x: _inverted(x, k, buckets), "bucket int, names binary, sizes binary, keys binary, places binary")
    shared = lists.groupBy("bucket").applyInPandas(giving_back(lambda x: _shared(x, buckets)), "bucket int, payload binary")
    first = shared.groupBy("bucket").applyInPandas(giving_back(lambda x: _prefixes(x, percent, buckets)), "bucket int, payload binary")
    units = components(first.groupBy("bucket").applyInPandas(giving_back(_meet), "a long, b long"))
    sizes = rows.filter("n_shingles > 0").groupBy("class").agg(F.count("*").alias("copies"), F.min("n_shingles").alias("n"), F.min(F.struct(F.col("doc_key").isNull().alias("none"), "doc_key", "content")).alias("least"))
    members = written(units.withColumnRenamed("node", "class").withColumnRenamed("root", "unit").join(sizes, "class"), "ngram-members")
    one_each = members.select("least.doc_key", "least.content", "class", "unit")
    # Units and links have no more classes than this.
    small = F.broadcast if members.count() <= most_broadcast else lambda df: df
    one_each = small(one_each)
    sets = written(
        source.join(one_each, source["doc_key"].eqNullSafe(one_each["doc_key"]) & (source["content"] == one_each["content"])).select("unit", "class", "text")
        .mapInPandas(lambda x: _marks(x, k), "unit long, class long, marks binary"),
        "ngram-sets",
    )
    weight = members.groupBy("unit").agg(F.sum("n").alias("weight"), F.min("class").alias("hub"))
    total, lanes = members.agg(F.sum("n")).first()[0] or 0, spark.sparkContext.defaultParallelism
    unit_shingles = unit_shingles or min(MOST_UNIT, max(LEAST_UNIT, total // (8 * lanes)))
    blocks = F.ceil(F.col("weight") / unit_shingles).cast("int")
    bins = max(1, lanes, -(-total // unit_shingles) * 8)
    weighed = sets.join(small(weight.withColumn("blocks", blocks)), "unit")
    own = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("unit"), F.lit(bins))).otherwise(F.xxhash64("unit", F.pmod(F.xxhash64("class"), F.col("blocks"))))
    whole = weighed.select("unit", "class", "marks", own.alias("task"))
    hubs = weighed.filter("class = hub AND blocks > 1").select("unit", "class", "marks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    hubs = hubs.select("unit", "class", "marks", F.xxhash64("unit", F.col("block").cast("long")).alias("task"))
    seek = giving_back(lambda x: _unit_links(x, percent))
    links = written(whole.unionByName(hubs).withColumn("seeker", F.lit(None).cast("boolean")).groupBy("task").applyInPandas(seek, "a long, b long"), "ngram-links")
    split = weighed.filter("blocks > 1").select("unit", "class", "marks", "blocks")
    if not split.isEmpty():
        links = written(links.unionByName(_outside(split, links, unit_shingles).groupBy("task").applyInPandas(seek, "a long, b long")), "ngram-links")
    # Classes first: each has one row, however many copies it has.
    linked = components(links).withColumnRenamed("node", "class")
    joined = sizes.join(small(linked), "class", "left").filter("copies > 1 OR root IS NOT NULL")
    return rows, written(joined.select("class", "copies", F.coalesce("root", "class").alias("root"), "least"), "ngram-joined")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, unit_shingles: int | None = None, bucket_docs: int = BUCKET_DOCS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every document.

    Two documents link when their sets of k-word shingles have a Jaccard similarity of at least
    percent / 100; shorter texts are one shingle. Words are cut at ASCII white space and A-Z
    lower-cased. Null, empty and blank texts have no shingles and link with nothing; repeated
    rows link with each other; an empty table gives no rows; further columns are ignored. Rows
    with a null key are searched like all others; a component of such rows alone has a null id.
    Texts may be of any length: hashing goes by pieces, and Arrow batches hold few long texts.

    A unit of more than unit_shingles (by default an eighth of a core's part, between 2^17 and
    2^21) is searched in blocks, each with the unit's smallest class; classes left outside the largest component are then searched against
    every block, so no link is lost and no task holds more than its share.
    """
    rows, joined = _joined(docs, key, text, k, percent, unit_shingles, bucket_docs, most_broadcast)
    least = joined.groupBy("root").agg(F.count("*").alias("copies"), F.min("least.doc_key").alias("component_id"))
    named = _looked_up(joined, least, "root", most_broadcast).select("class", "copies", "component_id")
    found = _looked_up(rows, written(named, "ngram-named"), "class", most_broadcast)
    return found.select(F.col("doc_key").alias(key), "n_shingles", F.coalesce("component_id", "doc_key").alias("component_id"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, unit_shingles: int | None = None, bucket_docs: int = BUCKET_DOCS, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """Which rows go so that one of each component stays: two tables of doc_key and content.

    content is xxhash64 of the text. The first table has the rows to drop. The row that stays
    has the smallest key, a null one only if there is no other, and of equal keys the smaller
    content. Rows equal in both are in the second table if they are among those that stay, so
    that the caller keeps one of them. Texts without shingles are such rows if both are equal.
    """
    rows, joined = _joined(docs, key, text, k, percent, unit_shingles, bucket_docs, most_broadcast)
    least = joined.groupBy("root").agg(F.count("*").alias("copies"), F.min("least").alias("component_id"))
    named = _looked_up(joined, least, "root", most_broadcast).select("class", "copies", "component_id")
    found = _looked_up(rows.filter("n_shingles > 0"), written(named, "ngram-named"), "class", most_broadcast).filter("component_id IS NOT NULL")
    first = F.col("doc_key").eqNullSafe(F.col("component_id.doc_key")) & (F.col("content") == F.col("component_id.content"))
    found = found.groupBy("doc_key", "content", first.alias("first")).agg(F.count("*").alias("n"))
    blank = rows.filter("n_shingles = 0").groupBy("doc_key", "content").agg(F.count("*").alias("n")).withColumn("first", F.lit(True))
    found = written(found.unionByName(blank).filter("NOT first OR n > 1"), "ngram-copies")
    return found.filter("NOT first").select("doc_key", "content"), found.filter("first").select("doc_key", "content")


def _looked_up(rows: DataFrame, table: DataFrame, on: str, most_broadcast: int) -> DataFrame:
    """rows with component_id from a table of `on`, copies (how many rows have it) and component_id, or null.

    The table is broadcast while its counted number of rows allows it. Beyond that only what
    has many copies is, which can't be more than most_broadcast rows, and the others, now
    without a hot one, are shuffled.
    """
    if table.count() <= most_broadcast:
        return rows.join(F.broadcast(table.select(on, "component_id")), on, "left")
    least = -(-rows.count() // max(1, most_broadcast))
    hot, cold = (table.filter(x).select(on, "component_id") for x in (F.col("copies") >= least, F.col("copies") < least))
    others = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on, "left")
    return others.unionByName(rows.join(F.broadcast(hot), on))


def _outside(split: DataFrame, links: DataFrame, unit_shingles: int) -> DataFrame:
    """For units in blocks: the classes outside the largest component, with every block."""
    found = components(links).withColumnRenamed("node", "class")
    at = written(split.join(found, "class", "left").withColumn("root", F.coalesce("root", "class")), "ngram-split")
    sizes = at.groupBy("unit", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("unit").agg(F.max(F.struct("n", "root")).getField("root").alias("largest"))
    outside = at.join(largest, "unit").filter("root <> largest")
    chunks = outside.groupBy("unit").agg(F.ceil(F.sum(F.length("marks") / 8) / unit_shingles).cast("int").alias("chunks"))
    task = lambda block, chunk: F.xxhash64("unit", block.cast("long"), chunk.cast("long"))
    block = F.pmod(F.xxhash64("class"), F.col("blocks"))
    sought = (
        outside.join(chunks, "unit").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("unit", "class", "marks", task(F.col("block"), F.col("chunk")).alias("task"), F.lit(True).alias("seeker"))
    )
    held = (
        at.join(chunks, "unit").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("unit", "class", "marks", task(block, F.col("chunk")).alias("task"), F.lit(False).alias("seeker"))
    )
    return sought.unionByName(held)


#: The query's settings in SQL: 4 words, 85 of 100.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
