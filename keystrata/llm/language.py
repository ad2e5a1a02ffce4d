"""Language of a text from words first, and from shorter and shorter n-grams of unseen words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm.shared import give_back

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Longest n-grams of unseen words.
LONGEST = 4
#: Words that a worker keeps ready.
READY = 300_000


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word between its end marks; single letters stand without them."""
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _tallies(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in rows:
        for lang, part in frame.groupby("lang"):
            words = Counter(w for text in part["text"] for w in LETTERS.findall(text.lower()))
            pieces = Counter()
            for word, n in words.items():
                for size in range(1, LONGEST + 1):
                    for gram in grams(word, size):
                        pieces[size, gram] += n
            rows_ = [(0, w, n) for w, n in words.items()] + [(size, g, n) for (size, g), n in pieces.items()]
            out = pd.DataFrame(rows_, columns=["size", "token", "n"])
            out["lang"] = lang
            yield out[["size", "token", "lang", "n"]]


class Backoff:
    """Log frequencies by language of words (size 0) and of n-grams by size."""

    def __init__(self, tallies: pd.DataFrame, smoothing: float = 0.5):
        self.langs = sorted(tallies["lang"].unique())
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.known: list[dict[str, int]] = []
        self.logs: list[np.ndarray] = []
        for size in range(LONGEST + 1):
            part = tallies[tallies["size"] == size]
            names = {t: i for i, t in enumerate(dict.fromkeys(part["token"]))}
            counts = np.zeros((len(names), len(self.langs)))
            np.add.at(counts, ([names[t] for t in part["token"]], [column[x] for x in part["lang"]]), part["n"])
            self.known.append(names)
            self.logs.append(np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * max(1, len(names))))

    def vector(self, word: str) -> np.ndarray:
        """A seen word's log frequencies; of an unseen one the mean over its longest seen n-grams."""
        seen = self.known[0].get(word)
        if seen is not None:
            return self.logs[0][seen]
        for size in range(LONGEST, 0, -1):
            table, logs = self.known[size], self.logs[size]
            found = [logs[table[g]] for g in grams(word, size) if g in table]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(self.langs))


class _Ready(dict):
    """Rows of a matrix by word, filled as words come."""

    def __init__(self, model: Backoff):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1024, len(model.langs)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.model.vector(word)
        self[word] = at
        return at


def _judged(texts: Iterable[str | None], model: Backoff, ready: list[_Ready]) -> tuple[list[str], list[float]]:
    """Language and score of each text; ready holds the words kept so far."""
    names, scores = [], []
    for text in texts:
        words = LETTERS.findall(text.lower()) if text else []
        if not model.langs or not any(c.isalpha() for w in words for c in w):
            names.append(UNDETERMINED)
            scores.append(0.0)
            continue
        at = np.fromiter(map(ready[0].__getitem__, words), np.int64, len(words))
        total = ready[0].rows[at].sum(axis=0)
        best = int(np.argmax(total))  # ties go to the first name
        names.append(model.langs[best])
        scores.append(float(1 / np.exp(total - total[best]).sum()))
        if len(ready[0]) > READY:
            ready[0] = _Ready(model)
    return names, scores


def _predicted(rows: Iterator[pd.DataFrame], model: Backoff) -> Iterator[pd.DataFrame]:
    ready = [_Ready(model)]
    for frame in rows:
        names, scores = _judged(frame["text"], model, ready)
        yield pd.DataFrame({"doc_key": frame["doc_key"], "lang_pred": names, "score": scores})
        del frame, names, scores
    ready.clear()
    give_back()


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1500, least: int = 2, language_bytes: int = 16 << 20) -> Backoff:
    """A model from at most per_language labelled documents of each language, chosen by hash of the key.

    They are taken in order of that hash while they have at most language_bytes of text
    together, and one at least, so what comes to the driver is bounded for each language. Words
    and n-grams seen fewer than `least` times in one language's sample are left out. Rows
    without key, text or label aren't learned from; of rows that repeat a key and label the
    least text counts; further columns are ignored.
    """
    rows = labelled.select(F.col(key).alias("doc_key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("doc_key IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    order = Window.partitionBy("lang").orderBy("mark", "doc_key")
    # About twice the wanted share of each language is ranked, so no task ranks all of a language.
    shares = rows.groupBy("lang").agg(F.count("*").alias("n")).withColumn("most", F.lit(2.0 * per_language * (1 << 20)) / F.col("n"))
    shares = F.broadcast(shares) if shares.count() <= 1 << 16 else shares
    drawn = rows.select("doc_key", "lang", F.xxhash64("doc_key").alias("mark"), F.octet_length("text").alias("bytes")).join(shares, "lang").filter(F.pmod("mark", F.lit(1 << 20)) <= F.col("most"))
    drawn = drawn.groupBy("doc_key", "lang", "mark").agg(F.min("bytes").cast("long").alias("bytes"))
    ranked = drawn.withColumn("rank", F.row_number().over(order)).withColumn("so_far", F.sum("bytes").over(order))
    chosen = ranked.filter((F.col("rank") == 1) | ((F.col("rank") <= per_language) & (F.col("so_far") <= language_bytes))).select("doc_key", "lang")
    if chosen.count() <= 1 << 20:
        chosen = F.broadcast(chosen)
    tallies = (
        rows.join(chosen, ["doc_key", "lang"], "left_semi").groupBy("doc_key", "lang").agg(F.min("text").alias("text")).select("lang", "text")
        .mapInPandas(_tallies, "size int, token string, lang string, n long")
        .groupBy("size", "token", "lang").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    )
    return Backoff(tallies.toPandas())


def predict(docs: DataFrame, model: Backoff, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (the posterior under equal priors) of every whole text.

    Null texts and texts without a letter are `und` with score 0; ties go to the language of
    the smaller name; texts may be of any length; repeated rows are each judged, null keys are
    kept; an empty table gives no rows; further columns are ignored. A model without languages
    calls every text `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("text"))
    kind = source.schema["doc_key"].dataType.simpleString()
    out = source.mapInPandas(lambda rows: _predicted(rows, shared.value), f"doc_key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("doc_key", key)


def judgement(spark: SparkSession, model: Backoff, text: Column) -> Column:
    """lang_pred and score of a text as a struct, by predict()'s rules, for filters that need no join."""
    shared = spark.sparkContext.broadcast(model)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = [_Ready(shared.value)]
        for texts in batches:
            names, scores = _judged(texts, shared.value, ready)
            yield pd.DataFrame({"lang_pred": names, "score": scores})
            del texts, names, scores
        ready.clear()
        give_back()

    # So that it is evaluated once for a row, wherever its result is used.
    return F.pandas_udf(judged, "lang_pred string, score double").asNondeterministic()(text)


def letters_in(text: Column) -> Column:
    """Whether a text has a letter, whatever the languages; false for null."""

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([any(c.isalpha() for c in x or "") for x in texts], dtype=bool)

    return F.pandas_udf(found, "boolean")(text)


def held_out(key: str = "doc_id"):
    """True for keys whose crc32, as text, leaves 2 when divided by 4; null keys are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
