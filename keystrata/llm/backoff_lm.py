"""Stupid-backoff scores from n-gram count tables, by joins on n-gram hashes.

score() states it in rows, for any order. score_bigrams() is the same plan for order 2 with the
rows of a hash partition packed into arrays, which takes a tenth of the shuffled bytes: the
unigram table is partitioned by word; bigrams meet, are counted and joined in the partition of
their first word (of both words where the first is frequent); those too rare go on to the
partition of their last word and join the unigram table there; documents sum what comes back.
Counts of frequent words and bigrams are broadcast, and their occurrences are scored where they
stand, so no partition holds a hot one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.decontaminate import let
from keystrata.llm.shared import ascii_lower, written
from keystrata.llm.words import mix, word_hashes

#: Documents and bytes of text of a batch, and bytes of text for each partition of the tables.
BATCH, BATCH_BYTES, SHARE = 1 << 13, 24 << 20, 12 << 20
#: Most words, and most bigrams, whose counts are broadcast.
MOST_FREQUENT = 1 << 18
#: Words are 48 bits of their hash; these two stand for the end of a text and for its start.
WORD, END, START = np.uint64((1 << 48) - 1), np.uint64(0), np.uint64(1)
#: Kinds of packed rows.
DOCS, SUMS, OPEN, TABLE, PAIRS = range(5)
PACKED = "kind int, to long, batch long, a binary, b binary, c binary, d binary, e binary, f binary"


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")


def _grams(words: Column, order: int) -> Column:
    """For each word: g1 to g<order>, hashes of the n-grams that end there, and c2 to c<order>, of all but their last words; null where there are none."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def ends(h: Column) -> Column:
        def at(_, i: Column) -> Column:
            back = [F.get(h, i - j) for j in range(order)]
            ending = [F.when(i >= n - 1, F.xxhash64(*reversed(back[:n]))).alias(f"g{n}") for n in range(1, order + 1)]
            before = [F.when(i >= n - 1, F.xxhash64(*reversed(back[1:n]))).alias(f"c{n}") for n in range(2, order + 1)]
            return F.struct(*ending, *before)

        return F.transform(h, at)

    return let(hashes, ends)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2, alpha: float = 0.4, least: int = 2) -> DataFrame:
    """n_words, log_score (summed natural logs) and mean_log_score of every whole text.

    The model's counts come from all documents. A word's score is count(n-gram) over
    count(its first n - 1 words) for the longest n-gram of at most `order` words with at least
    `least` occurrences, times alpha for each longer n-gram that is too rare; for single
    words, which always occur, count over all words. Words are cut at ASCII white space and A-Z lower-cased.

    Each order's table is one aggregate by hash. At each order the n-grams still open are
    joined with it: those found leave their context for the next lower order, those not found
    go on there. Null, empty and blank texts have no words, log_score 0 and a null mean.
    Rows that repeat a key are one document; null keys are one, too. An empty table gives no
    rows; further columns are ignored.
    """
    source = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("text"))
    grams = source.select("doc_key", F.explode(let(_words(F.col("text")), lambda w: _grams(w, order))).alias("x")).select("doc_key", "x.*")
    sized = written(source.groupBy("doc_key").agg(F.sum(F.size(_words(F.col("text")))).cast("long").alias("n_words")), "lm-words")
    total = sized.agg(F.sum("n_words")).first()[0] or 0
    tables = {}
    for n in range(1, order + 1):
        counted = grams.filter(F.col(f"g{n}").isNotNull()).groupBy(F.col(f"g{n}").alias("gram")).agg(F.count("*").alias("c"))
        # Of an order with no order above it only the n-grams that count are looked up.
        tables[n] = written(counted.filter(F.col("c") >= least) if n == order > 1 else counted, "lm-counts")
    open_ = grams.withColumn("n", F.lit(1)).withColumn("fixed", F.lit(0.0))
    sums: list[DataFrame] = []
    looked: DataFrame | None = None
    for n in range(order, 0, -1):
        counts = tables[n] if n == 1 else tables[n].filter(F.col("c") >= least)
        if looked is not None:
            # Contexts occur at least as often as the n-gram found, so the full table has them.
            found = looked.groupBy("doc_key", "gram").agg(F.sum("n").alias("n")).join(tables[n], "gram")
            sums.append(found.groupBy("doc_key").agg(F.sum(-F.log("c") * F.col("n")).alias("part")))
        joined = open_.join(counts.withColumnRenamed("gram", f"g{n}"), f"g{n}", "left")
        hit = joined.filter(F.col("c").isNotNull())
        if n == 1:
            sums.append(joined.groupBy("doc_key").agg(F.sum((F.log("c") - log(max(total, 1)) + F.col("fixed"))).alias("part")))
            break
        sums.append(hit.groupBy("doc_key").agg(F.sum(F.log("c") + F.col("fixed")).alias("part")))
        looked = hit.select("doc_key", F.col(f"c{n}").alias("gram"), "n")
        less = F.when(F.col(f"g{n}").isNotNull(), F.lit(log(alpha))).otherwise(0.0)
        open_ = joined.filter(F.col("c").isNull()).withColumn("fixed", F.col("fixed") + less).drop("c", f"g{n}", f"c{n}")
    parts = sums[0]
    for more in sums[1:]:
        parts = parts.unionByName(more)
    scored = parts.groupBy("doc_key").agg(F.sum("part").alias("log_score"))
    both = sized.join(scored, sized["doc_key"].eqNullSafe(scored["doc_key"]), "left").select(sized["doc_key"], "n_words", F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
    return both.select(F.col("doc_key").alias(key), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def _rows(made: list[tuple]) -> pd.DataFrame:
    """Packed rows of kind, to, batch and up to six arrays."""
    return pd.DataFrame([(*x[:3], *(c if c is None or isinstance(c, bytes) else c.tobytes() for c in x[3:]), *[None] * (9 - len(x))) for x in made], columns=["kind", "to", "batch", *"abcdef"])


def _array(frame: pd.DataFrame, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in frame[column] if x is not None), kind)


def _split(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (word & np.uint64(0xFFFFFFFF)).astype("<u4"), (word >> np.uint64(32)).astype("<u2")


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def _cuts(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Runs of at most BATCH texts that have at most BATCH_BYTES together, or of one longer text."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text.encode("utf-8", "surrogatepass")) if text else 0
        if i > start and (i - start >= BATCH or held + size > BATCH_BYTES):
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def _batches(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray]]:
    """A number for each batch, its rows, the words of all its texts, and how many each text has."""
    n = 0
    for frame in rows:
        for at, end in _cuts(frame["text"]):
            part = frame.iloc[at:end]
            words = [w & WORD for w in word_hashes(part["text"])]
            sizes, flat = np.array([len(w) for w in words], np.int64), np.concatenate(words)
            del words
            flat[flat <= START] += np.uint64(2)
            yield TaskContext.get().partitionId() << 24 | n, part, flat, sizes
            n += 1


class Frequent:
    """Logarithms of the counts of words that would fill a partition by themselves."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.logs = np.append(words[order], WORD), np.append(np.log(counts[order]), 0.0)

    def holds(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, words)
        return (self.words[at] == words) & (at < len(self.words) - 1)

    def log(self, words: np.ndarray) -> np.ndarray:
        return self.logs[np.searchsorted(self.words, words)]


def _both(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(3) + second)


class HotPairs:
    """Logarithms of the counts of bigrams that would fill a partition by themselves."""

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray):
        keys = _both(first, second)
        order = np.argsort(keys)
        self.keys, self.first, self.second, self.logs = keys[order], first[order], second[order], np.log(counts[order])

    def places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The place of each bigram here, -1 for the others."""
        if not len(self.keys):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.keys, _both(first, second)), len(self.keys) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)


def _count_words(rows: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    for _, _, flat, _ in _batches(rows):
        words, counts = np.unique(flat, return_counts=True)
        to = (words & np.uint64(parts - 1)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        words, counts, to = words[order], counts[order].astype("<u4"), to[order]
        first = _runs(to)
        yield _rows([(TABLE, int(to[i]), 0, words[i:j], counts[i:j]) for i, j in zip(first, np.append(first[1:], len(to)))])


def _word_table(frame: pd.DataFrame) -> pd.DataFrame:
    words, counts = _array(frame, "a", "<u8"), _array(frame, "b", "<u4")
    order = np.argsort(words, kind="stable")
    first = _runs(words[order])
    total = np.add.reduceat(counts[order].astype("<u8"), first)
    return _rows([(TABLE, int(frame["to"].iloc[0]), int(total.sum()), words[order][first], total)])


def _frequent(rows: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for frame in rows:
        words, counts = _array(frame, "a", "<u8"), _array(frame, "b", "<u8")
        yield pd.DataFrame({"word": words[counts >= least].view(np.int64), "n": counts[counts >= least].astype(np.int64)})


def _followed(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The word after each word, END after a text's last."""
    second = np.append(flat[1:], END)
    second[np.cumsum(n)[n > 0] - 1] = END
    return second


def _count_pairs(rows: Iterator[pd.DataFrame], frequent: Frequent) -> Iterator[pd.DataFrame]:
    """Bigrams of two frequent words; no other bigram can be as frequent as they are."""
    for _, _, flat, n in _batches(rows):
        if len(flat):
            second = _followed(flat, n)
            both = frequent.holds(flat)
            both[both] = frequent.holds(second[both])
            first, second = flat[both], second[both]
            order = np.lexsort((second, first))
            first, second = first[order], second[order]
            at = _runs(first, second)
            yield pd.DataFrame({"first": first[at].view(np.int64), "second": second[at].view(np.int64), "n": _lengths(at, len(first))})


def _pairs(rows: Iterator[pd.DataFrame], parts: int, frequent: Frequent, hot: HotPairs) -> Iterator[pd.DataFrame]:
    """The bigrams of each batch by partition; each text's last word with END, its first with START.

    What is known of frequent words is summed here: their START, and hot bigrams. Their END only
    serves to count them, which is done.
    """
    kind = "<u2" if parts <= 1 << 16 else "<u4"
    for batch, part, flat, n in _batches(rows):
        yield _rows([(DOCS, batch % parts, batch, json.dumps(part["doc_key"].where(part["doc_key"].notna(), None).tolist()).encode(), n.astype("<u4"))])
        if not len(flat):
            continue
        ends = np.cumsum(n)[n > 0]
        second = _followed(flat, n)
        owner = np.arange(len(n))[n > 0]
        docs = np.concatenate([np.repeat(np.arange(len(n), dtype="<u2"), n), owner.astype("<u2")])
        first = np.concatenate([flat, flat[ends - n[n > 0]]])
        del flat
        second = np.concatenate([second, np.full(len(owner), START)])
        often = frequent.holds(first)
        if often.any():
            f, s, d = first[often], second[often], docs[often]
            place, start = hot.places(f, s), s == START
            value = np.where(start, frequent.log(f), 0.0)
            known = place >= 0
            value[known] = hot.logs[place[known]] - frequent.log(f[known])
            here = start | known
            if here.any():
                slots, value, uses = _sums(d[here].astype(np.int64), value[here], start[here].astype(np.int64))
                yield _rows([(SUMS, batch % parts, 0, np.array([batch], "<i8"), np.array([len(slots)], "<u4"), slots.astype("<u2"), value, uses.astype("<u4"))])
            rest = ~often
            rest[often] = ~here & (s != END)
            first, second, docs, often = first[rest], second[rest], docs[rest], often[rest]
        if not len(first):
            continue
        to = (first & np.uint64(parts - 1)).astype(kind)
        to[often] = (_both(first[often], second[often]) & np.uint64(parts - 1)).astype(kind)
        order = np.lexsort((second, first, to))
        first, second, docs, to = first[order], second[order], docs[order], to[order]
        pair = _runs(to, first, second)
        count = _lengths(pair, len(to)).astype("<u4")
        word = _runs(to[pair], first[pair])
        low, high = _split(second[pair])
        cut = _runs(to[pair[word]])
        made = []
        for i, j in zip(cut, np.append(cut[1:], len(word))):
            p, q = word[i], word[j] if j < len(word) else len(pair)
            a, b = pair[p], pair[q] if q < len(pair) else len(to)
            made.append((PAIRS, int(to[a]), batch, first[pair[word[i:j]]], _lengths(word[i:j] - p, q - p).astype("<u4"), low[p:q], high[p:q], count[p:q], docs[a:b]))
        yield _rows(made)


def _sums(slot: np.ndarray, value: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by slot (batch place and document)."""
    order = np.argsort(slot, kind="stable")
    first = _runs(slot[order])
    if not len(first):
        return slot, value, uses
    return slot[order][first], np.add.reduceat(value[order], first), np.add.reduceat(uses[order], first)


def _score_pairs(frame: pd.DataFrame, parts: int, least: int, alpha: float, frequent: Frequent) -> pd.DataFrame:
    held = frame[frame["kind"] == PAIRS]
    out = [(DOCS, int(x.to), int(x.batch), x.a, x.b) for x in frame[frame["kind"] == DOCS].itertuples()]
    out += [(SUMS, int(x.to), 0, x.a, x.b, x.c, x.d, x.e) for x in frame[frame["kind"] == SUMS].itertuples()]
    if not len(held):
        return _rows(out)
    batches = held["batch"].to_numpy(np.int64)
    words = [np.frombuffer(x, "<u8") for x in held["a"]]
    first = np.concatenate([np.repeat(w, np.frombuffer(n, "<u4")) for w, n in zip(words, held["b"])])
    second = _joined(_array(held, "c", "<u4"), _array(held, "d", "<u2"))
    count = _array(held, "e", "<u4").astype(np.int64)
    place = np.repeat(np.arange(len(held)), [len(x) // 4 for x in held["e"]])
    order = np.lexsort((second, first))
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.arange(len(order))
    f, s, c = first[order], second[order], count[order]
    pair, word = _runs(f, s), _runs(f)
    c2 = np.repeat(np.add.reduceat(c, pair), _lengths(pair, len(f)))
    c1 = np.repeat(np.add.reduceat(np.where(s == START, 0, c), word), _lengths(word, len(f)))
    known = frequent.holds(f)
    log1 = np.where(known, frequent.log(f), np.log(np.maximum(c1, 1)))
    value, uses = np.zeros(len(f)), np.zeros(len(f), np.int64)
    start, real = s == START, s > START
    value[start], uses[start] = log1[start], 1
    seen = real & (c2 >= least)
    value[seen] = np.log(c2[seen]) - log1[seen]
    rare = real & ~seen
    value[rare] = log(alpha)
    near = rare & frequent.holds(s)
    value[near] += frequent.log(s[near])
    uses[near] = 1
    value, uses, open_ = value[inverse], uses[inverse], (rare & ~near)[inverse]
    docs = _array(held, "f", "<u2").astype(np.int64)
    each = np.repeat(np.arange(len(count)), count)
    slot = place[each] << 16 | docs
    real = (second != END)[each]
    slots, value, uses = _sums(slot[real], value[each[real]], uses[each[real]])
    run = _runs(slots >> 16)
    own = int(frame["to"].iloc[0])
    out.append((SUMS, own, 0, batches[slots[run] >> 16], _lengths(run, len(slots)).astype("<u4"), (slots & 65535).astype("<u2"), value, uses.astype("<u4")))
    left = open_[each]
    word, slot = second[each[left]], slot[left]
    to = (word & np.uint64(parts - 1)).astype(np.int64)
    order = np.lexsort((slot, to))
    word, slot, to = word[order], slot[order], to[order]
    cut = _runs(to)
    for i, j in zip(cut, np.append(cut[1:], len(to))):
        run = _runs(slot[i:j] >> 16)
        low, high = _split(word[i:j])
        out.append((OPEN, int(to[i]), 0, batches[slot[i:j][run] >> 16], _lengths(run, j - i).astype("<u4"), low, high, (slot[i:j] & 65535).astype("<u2")))
    return _rows(out)


def _score_words(frame: pd.DataFrame) -> pd.DataFrame:
    out = [(DOCS, int(x.batch), int(x.batch), x.a, x.b) for x in frame[frame["kind"] == DOCS].itertuples()]
    table, open_, sums = (frame[frame["kind"] == k] for k in (TABLE, OPEN, SUMS))
    batch = lambda x: np.repeat(_array(x, "a", "<i8"), _array(x, "b", "<u4"))
    owner = np.concatenate([batch(sums), batch(open_)])
    if not len(owner):
        return _rows(out)
    docs = np.concatenate([_array(sums, "c", "<u2"), _array(open_, "e", "<u2")]).astype(np.int64)
    words, counts = _array(table, "a", "<u8"), _array(table, "b", "<u8")
    asked = _joined(_array(open_, "c", "<u4"), _array(open_, "d", "<u2"))
    logs = np.log(counts[np.searchsorted(words, asked)]) if len(asked) else np.zeros(0)
    names, place = np.unique(owner, return_inverse=True)
    slots, value, uses = _sums(place << 16 | docs, np.concatenate([_array(sums, "d", "<f8"), logs]), np.concatenate([_array(sums, "e", "<u4").astype(np.int64), np.ones(len(asked), np.int64)]))
    run = _runs(slots >> 16)
    for i, j in zip(run, np.append(run[1:], len(slots))):
        b = int(names[slots[i] >> 16])
        out.append((SUMS, b, b, (slots[i:j] & 65535).astype("<u2"), value[i:j], uses[i:j].astype("<u4")))
    return _rows(out)


def _documents(frame: pd.DataFrame) -> pd.DataFrame:
    row, sums = frame[frame["kind"] == DOCS].iloc[0], frame[frame["kind"] == SUMS]
    n = np.frombuffer(row["b"], "<u4").astype(np.int64)
    docs = _array(sums, "a", "<u2")
    total = np.bincount(docs, _array(sums, "b", "<f8"), len(n))
    uses = np.bincount(docs, _array(sums, "c", "<u4"), len(n)).astype(np.int64)
    return pd.DataFrame({"doc_key": pd.Series(json.loads(row["a"]), dtype=object), "n_words": n, "total": total, "uses": uses})


def score_bigrams(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 0.4, least: int = 2, share: int = SHARE) -> DataFrame:
    """score() with order 2, for every row; share: bytes of text for each partition of the tables.

    Words with a quarter of a partition's share of all words are frequent, and bigrams of two
    such words as many are hot (at most MOST_FREQUENT of each, by a higher bound if need be).
    Their counts are broadcast: hot bigrams are scored where they stand, other bigrams of
    frequent words are spread by both words. So a partition holds about `share` bytes of text,
    whatever the input, until the bound rises above a quarter of a share (0.8 TB at the default
    share). Batches have at most BATCH_BYTES of text, or one text that is longer.

    Null, empty and blank texts have no words, log_score 0 and a null mean; rows that repeat a
    key and rows with a null key are documents of their own; an empty table gives no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("string").alias("doc_key"), F.col(text).alias("text"))
    held = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = 1 << min(31, max(2, (held // share).bit_length()))
    table = written(
        source.select("text").mapInPandas(lambda x: _count_words(x, parts), PACKED).groupBy("to").applyInPandas(_word_table, PACKED), "lm-words"
    )
    total = table.agg(F.sum("batch")).first()[0] or 0  # a partition's words
    most = max(least, total // min(4 * parts, MOST_FREQUENT))
    often = table.mapInPandas(lambda x: _frequent(x, most), "word long, n long").toPandas()
    frequent = spark.sparkContext.broadcast(Frequent(often["word"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)))
    none = np.zeros(0, np.int64)
    first, second, n = none, none, none
    if len(often):
        counted = source.select("text").mapInPandas(lambda x: _count_pairs(x, frequent.value), "first long, second long, n long")
        found = counted.groupBy("first", "second").agg(F.sum("n").alias("n")).filter(F.col("n") >= most).toPandas()
        first, second, n = (found[c].to_numpy(np.int64) for c in ("first", "second", "n"))
    hot = spark.sparkContext.broadcast(HotPairs(first.view(np.uint64), second.view(np.uint64), n))
    pairs = source.mapInPandas(lambda x: _pairs(x, parts, frequent.value, hot.value), PACKED)
    first = pairs.groupBy("to").applyInPandas(lambda x: _score_pairs(x, parts, least, alpha, frequent.value), PACKED)
    second = first.unionByName(table).groupBy("to").applyInPandas(_score_words, PACKED)
    found = second.groupBy("to").applyInPandas(_documents, "doc_key string, n_words long, total double, uses long")
    score_ = F.col("total") - F.col("uses") * log(max(total, 1))
    found = found.select(F.col("doc_key").cast(docs.schema[key].dataType).alias(key), "n_words", score_.alias("log_score"))
    return found.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
