"""Source, language and topic mixture by iterative proportional fitting, and a sample drawn by it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.shared import written
from keystrata.llm.words import word_hashes

MARGINS = ("source", "lang", "topic")
#: Most cells that are raked on the driver; more are raked as a table.
MOST_CELLS = 1 << 18
#: Topic of texts without words.
WORDLESS = "none"
#: Texts whose words are counted and placed at once.
TOGETHER = 256


class Topics:
    """Clusters of texts by their words: hashed, damped and weighted counts nearest to a centre.

    Texts and centres are vectors of length 1 in whole parts of 2^26, so sums and products are
    exact in 64 bits and the model is the same however the rows are dealt out.
    """

    PARTS = float(1 << 26)

    def __init__(self, weights: np.ndarray, centres: np.ndarray):
        self.weights, self.centres = weights, centres

    @staticmethod
    def counts(texts: Sequence[str | None], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many hashed kinds of words each text has; the kinds, text by text; and how often each occurs."""
        words = list(word_hashes(texts))
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        place = owner * dims + (np.concatenate(words) % np.uint64(dims)).astype(np.int64) if words else owner
        held = np.bincount(place, minlength=len(words) * dims)
        place = np.flatnonzero(held)
        return np.bincount(place // dims, minlength=len(words)), place % dims, held[place]

    def placed(self, kinds: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The vector of each text; zeros where it has no words."""
        owner = np.repeat(np.arange(len(kinds)), kinds)
        x = np.log1p(count.astype(np.float64)) * self.weights[place]
        length = np.sqrt(np.bincount(owner, x * x, len(kinds)))
        out = np.zeros((len(kinds), len(self.weights)))
        out[owner, place] = np.rint(x / length[owner] * self.PARTS)
        return out

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The centre of each vector; ties go to the smaller number."""
        return (x @ self.centres.T).argmax(axis=1)

    def of(self, texts: Sequence[str | None]) -> list[str]:
        """Topics t0, t1, ...; ties go to the smaller number."""
        out = []
        for i in range(0, len(texts), TOGETHER):
            kinds, place, count = self.counts(texts[i : i + TOGETHER], len(self.weights))
            best = self.nearest(self.placed(kinds, place, count)) if len(self.centres) else kinds
            out += [f"t{b}" if n and len(self.centres) else WORDLESS for b, n in zip(best, kinds)]
        return out


def _counted(frames: Iterator[pd.DataFrame], dims: int) -> Iterator[pd.DataFrame]:
    """The counts of texts with words, TOGETHER texts a row."""
    for frame in frames:
        rows = []
        for i in range(0, len(frame), TOGETHER):
            part = frame.iloc[i : i + TOGETHER]
            kinds, place, count = Topics.counts(part["text"].tolist(), dims)
            some = kinds > 0
            if some.any():
                count = count.astype(np.min_scalar_type(count.max()))
                rows.append((part["mark"].to_numpy(np.int64)[some].tobytes(), kinds[some].astype("<u4").tobytes(), place.astype("<u4" if dims > 1 << 16 else "<u2").tobytes(), count.tobytes()))
        yield pd.DataFrame(rows, columns=["marks", "kinds", "places", "counts"])


def _slices(frames: Iterator[pd.DataFrame], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What _counted() packed: marks, and the three results of Topics.counts()."""
    for frame in frames:
        for marks, kinds, places, counts in frame.itertuples(index=False):
            place = np.frombuffer(places, "<u4" if dims > 1 << 16 else "<u2").astype(np.int64)
            yield np.frombuffer(marks, np.int64), np.frombuffer(kinds, "<u4").astype(np.int64), place, np.frombuffer(counts, f"u{len(counts) // len(place)}")


def _summed(held: DataFrame, tally: Callable[[Iterator[pd.DataFrame]], np.ndarray], size: int) -> np.ndarray:
    """The sum of each task's vector of whole numbers; one row a place comes to the driver."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = tally(frames).astype(np.int64)
        place = np.flatnonzero(total)
        yield pd.DataFrame({"place": place, "total": total[place]})

    out = np.zeros(size, np.int64)
    found = held.mapInPandas(sums, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).toPandas()
    out[found["place"].to_numpy(np.int64)] = found["total"].to_numpy(np.int64)
    return out


def _farthest(held: DataFrame, model: Topics) -> tuple[float, np.ndarray] | None:
    """The text farthest from its nearest centre, and how near; of several the least by hash. Without centres the least of all."""
    dims = len(model.weights)

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for marks, *counts in _slices(frames, dims):
            x = model.placed(*counts)
            near = (x @ model.centres.T).max(axis=1, initial=0.0)
            at = np.lexsort((marks, near))[0]
            if best is None or (near[at], marks[at]) < best[:2]:
                best = near[at], marks[at], x[at].tobytes()
        yield pd.DataFrame([best] if best else [], columns=["near", "mark", "vector"])

    found = held.mapInPandas(least, "near double, mark long, vector binary").agg(F.min(F.struct("near", "mark", "vector")).alias("x")).first()["x"]
    return None if found is None else (found["near"] / Topics.PARTS**2, np.frombuffer(found["vector"]))


def fit_topics(docs: DataFrame, text: str = "text", number: int = 8, sample: int | None = None, dims: int = 512, rounds: int = 12) -> Topics:
    """Spherical k-means over all texts, from centres far apart; topics are numbered from the largest.

    Words are counted once into a table; weights, first centres and each round are sums over
    all of it, of which the driver gets a row for each kind of word and centre. Every row
    counts, so copies count as often as they occur. Rounds end early when no centre moves.
    sample: fit on at most so many distinct texts, chosen by hash, instead of all.
    """
    rows = docs.select(F.col(text).alias("text")).filter("text IS NOT NULL").withColumn("mark", F.xxhash64("text"))
    if sample is not None:
        n = rows.count()
        share = F.pmod(F.col("mark"), F.lit(1 << 30)) <= F.lit(int(min(1.0, 2.0 * sample / max(n, 1) + 1e-4) * (1 << 30)))
        drawn = rows.filter(share).select("mark").distinct().orderBy("mark").limit(sample)
        rows = rows.join(F.broadcast(drawn), "mark").groupBy("mark").agg(F.min("text").alias("text"))
    held = written(rows.select("mark", "text").mapInPandas(lambda x: _counted(x, dims), "marks binary, kinds binary, places binary, counts binary"), "mix-words")

    def occurring(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros(dims + 1, np.int64)
        for marks, _, place, _ in _slices(frames, dims):
            total += np.append(np.bincount(place, minlength=dims), len(marks))
        return total

    texts = _summed(held, occurring, dims + 1)
    model = Topics(np.log((1 + texts[dims]) / (1 + texts[:dims])) + 1, np.zeros((0, dims)))
    while len(model.centres) < number and (far := _farthest(held, model)) and (not len(model.centres) or far[0] < 1 - 1e-6):
        model = Topics(model.weights, np.vstack([model.centres, far[1]]))

    def moved(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        """The sum of the vectors of each topic, and behind them its number of texts."""
        sums, size = np.zeros(model.centres.shape, np.int64), np.zeros(len(model.centres), np.int64)
        for _, *counts in _slices(frames, dims):
            x = model.placed(*counts)
            topic = model.nearest(x)
            sums += ((topic == np.arange(len(size))[:, None]).astype(np.float64) @ x).astype(np.int64)
            size += np.bincount(topic, minlength=len(size))
        return np.append(sums, size)

    k = len(model.centres)
    for i in range(rounds + 1 if k else 0):
        total = _summed(held, moved, k * (dims + 1))
        sums, size = total[: k * dims].reshape(k, dims).astype(np.float64), total[k * dims :]
        centres = np.where(size[:, None] > 0, np.rint(sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1.0) * Topics.PARTS), model.centres)
        if i == rounds or (centres == model.centres).all():
            return Topics(model.weights, model.centres[np.argsort(-size, kind="stable")])
        model = Topics(model.weights, centres)
    return model


def topic_of(spark: SparkSession, model: Topics, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.of(texts.tolist()), dtype=object)

    return F.pandas_udf(found, "string").asNondeterministic()(text)


def tokens_of(text: Column) -> Column:
    """Runs of non-white-space, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def tempered(shares: Mapping[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(weights: np.ndarray, places: np.ndarray, targets: list[np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """A factor for each cell so that weights * factor has the target shares on every margin.

    places: cells by margins, the category of each. Margins are fitted in turn until no share
    moves by more than the tolerance; a category without weight or target stays at 0.
    """
    factor = np.ones(len(weights))
    for _ in range(rounds):
        worst = 0.0
        for m, target in enumerate(targets):
            now = np.bincount(places[:, m], weights * factor, len(target))
            share = now / max(now.sum(), 1e-300)
            worst = max(worst, float(np.abs(share - target).max(initial=0)))
            step = np.divide(target * now.sum(), now, out=np.zeros_like(now), where=now > 0)
            factor *= step[places[:, m]]
        if worst <= tolerance:
            break
    return factor


def _rake_table(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """rake() for more cells than the driver should hold: each step is an aggregate and a join."""
    state = cells.withColumn("factor", F.lit(1.0))
    for _ in range(rounds):
        worst = 0.0
        for name, target in targets.items():
            now = state.groupBy(name).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now"))
            total = now.agg(F.sum("now")).first()[0] or 0.0
            step = now.join(target, name, "left").select(name, F.coalesce("target", F.lit(0.0)).alias("target"), "now")
            gap = step.agg(F.max(F.abs(F.col("now") / F.lit(max(total, 1e-300)) - F.col("target")))).first()[0]
            worst = max(worst, gap or 0.0)
            scale = F.when(F.col("now") > 0, F.col("target") * total / F.col("now")).otherwise(0.0)
            state = written(state.join(step.select(name, scale.alias("step")), name).withColumn("factor", F.col("factor") * F.col("step")).drop("step"), "rake")
        if worst <= tolerance:
            break
    return state


def _weighed(docs: DataFrame, key: str, text: str, source: str, lang: str, topic: Column, *more: Column) -> DataFrame:
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return docs.select(
        F.col(key).alias("doc_key"), known(source).alias("source"), known(lang).alias("lang"), F.coalesce(topic.cast("string"), F.lit("unknown")).alias("topic"),
        tokens_of(F.col(text)).alias("n_tokens"), F.xxhash64(F.col(text)).alias("content"), *more,
    )


def _fitted(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, power: float, rounds: int, tolerance: float, most_cells: int, scale_share: float) -> tuple[DataFrame, float]:
    """A factor for each cell of weighed rows, and the one that stands for probability 1."""
    spark = rows.sparkSession
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens")), "mix-cells")
    shares = {}
    for name in MARGINS:
        if targets and name in targets:
            shares[name] = spark.createDataFrame([(k, float(v)) for k, v in tempered(targets[name], 1.0).items()], f"{name} string, target double")
        else:
            raised = F.pow(F.sum("tokens"), F.lit(power))
            own = cells.groupBy(name).agg(raised.alias("raised"))
            total = own.agg(F.sum("raised")).first()[0] or 1.0
            shares[name] = own.select(name, (F.col("raised") / total).alias("target"))
    if cells.count() <= most_cells:
        held = cells.orderBy(*MARGINS).toPandas()
        places, wanted = [], []
        for name in MARGINS:
            target = {r[name]: r["target"] for r in shares[name].collect()}
            categories, place = np.unique(held[name].to_numpy(str), return_inverse=True)
            places.append(place)
            wanted.append(np.array([target.get(c, 0.0) for c in categories]))
        held["factor"] = rake(held["tokens"].to_numpy(), np.stack(places, 1), wanted, rounds, tolerance) if len(held) else []
        fitted = F.broadcast(spark.createDataFrame(list(held[[*MARGINS, "tokens", "factor"]].itertuples(index=False, name=None)), "source string, lang string, topic string, tokens double, factor double"))
    else:
        fitted = _rake_table(cells, shares, rounds, tolerance).select(*MARGINS, "tokens", "factor")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    some, every = fitted.agg(F.max(F.when(F.col("tokens") >= scale_share * total, F.col("factor"))), F.max("factor")).first()
    return fitted.drop("tokens"), some or every or 1.0


def _drawn(rows: DataFrame, fitted: DataFrame, scale: float, seed: int) -> DataFrame:
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_key", "content"), 11).cast("double") / float(1 << 53)
    placed = rows.join(fitted, list(MARGINS)).withColumn("probability", F.least(F.lit(1.0), F.col("factor") / scale))
    return placed.withColumn("kept", draw < F.col("probability"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, targets: Mapping[str, Mapping[str, float]] | None = None, power: float = 0.9, rounds: int = 200, tolerance: float = 1e-9, seed: int = 17, most_cells: int = MOST_CELLS, topics: int = 8, topic_sample: int | None = None, scale_share: float = 1e-3) -> DataFrame:
    """The calibrated weight of every document and whether the sample takes it.

    Tokens, which are runs of non-white-space, are counted by source, language and topic over
    all documents. Raking finds a factor for each cell so that the token weights meet the
    targets' shares on all three margins; targets left out are the corpus's own shares raised
    to `power`. A document's probability is its cell's factor divided by the largest of cells
    with at least scale_share of all tokens (of all cells where none has), and 1 at most, so
    that no cell of a few documents thins out all others; it is kept if a hash of its key and
    text lies below. Without a topic column, topics are `topics`
    clusters of texts by their words, fitted on all texts (with topic_sample on at most so
    many); every text has the nearest. Returns key, source, lang, topic, n_tokens, factor, probability and kept.

    Null categories are the category "unknown"; categories without a target get probability 0;
    null and wordless texts count one token and have the topic "none"; texts may be of any
    length; rows that repeat key and text share their fate; an empty table gives no rows;
    further columns are ignored.
    """
    topic = topic_of(docs.sparkSession, fit_topics(docs, text, topics, topic_sample), F.col(text)) if topic is None else topic
    rows = written(_weighed(docs, key, text, source, lang, topic), "mix-rows")
    found = _drawn(rows, *_fitted(rows, targets, power, rounds, tolerance, most_cells, scale_share), seed)
    return found.select(F.col("doc_key").alias(key), *MARGINS, "n_tokens", "factor", "probability", "kept")


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Mapping[str, Mapping[str, float]] | None = None, power: float = 0.9, rounds: int = 200, tolerance: float = 1e-9, seed: int = 17, most_cells: int = MOST_CELLS, topics: int = 8, topic_sample: int | None = None, scale_share: float = 1e-3) -> DataFrame:
    """The rows of docs that mix() keeps, with all their columns.

    Texts are read three times, for the topics, the cells and the draw, and never shuffled while
    the cells are few enough to be raked on the driver.
    """
    topic = topic_of(docs.sparkSession, fit_topics(docs, text, topics, topic_sample), F.col(text))
    rows = _weighed(docs, key, text, source, lang, topic, F.struct(*docs.columns).alias("whole"))
    fitted, scale = _fitted(rows, targets, power, rounds, tolerance, most_cells, scale_share)
    return _drawn(rows, fitted, scale, seed).filter("kept").select("whole.*")
