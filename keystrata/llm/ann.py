"""Maximum inner product search over anisotropic four-bit codes, with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import written

#: Centres of a subspace: a code has four bits.
CENTRES = 16
#: Standard deviations of the scan's error within which a candidate is still reranked, and the rounding of its tables.
SLACK, ROUNDING = 4.0, 1e-5
#: Most bytes of queries that are broadcast; more meet the candidates by a join.
MOST_BROADCAST = 32 << 20


class Quantizer:
    """Product codes whose error along the vector weighs more than the error across it.

    For vectors x with residual r, the loss is |r|^2 + (eta - 1) (r . x / |x|)^2, where eta
    follows from the least cosine `threshold` of the query-vector pairs that matter.
    """

    def __init__(self, centres: np.ndarray, eta: float, dims: int):
        self.centres, self.eta, self.dims = centres, eta, dims

    @staticmethod
    def _parts(vectors: np.ndarray, width: int) -> np.ndarray:
        """vectors, subspaces (an even number), width; padded with zeros."""
        pad = -vectors.shape[1] % (2 * width)
        return np.pad(vectors, ((0, 0), (0, pad))).reshape(len(vectors), -1, width)

    @classmethod
    def fit(cls, sample: np.ndarray, threshold: float = 0.2, width: int = 2, rounds: int = 8, seed: int = 1) -> Quantizer:
        dims = sample.shape[1]
        eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
        parts = cls._parts(sample, width)
        rng = np.random.default_rng(seed)
        centres = np.stack([parts[rng.integers(0, len(parts), CENTRES), m] for m in range(parts.shape[1])])
        model = cls(centres, 1.0, dims)
        for i in range(rounds):
            model.eta = 1.0 if i < rounds // 2 else eta
            model._update(sample, model.codes(sample))
        model.eta = eta
        return model

    def _directions(self, vectors: np.ndarray) -> np.ndarray:
        return self._parts(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), self.centres.shape[2])

    def codes(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """The nearest centres, then sweeps over the subspaces that lower the loss."""
        x, along = self._parts(vectors, self.centres.shape[2]), self._directions(vectors)
        count = x.shape[1]
        square = [((x[:, m, None] - self.centres[m]) ** 2).sum(-1) for m in range(count)]
        code = np.stack([s.argmin(1) for s in square], 1)
        if self.eta <= 1:
            return code.astype(np.uint8)
        every = np.arange(len(x))
        drift = [((x[:, m, None] - self.centres[m]) * along[:, m, None]).sum(-1) for m in range(count)]
        total = sum(drift[m][every, code[:, m]] for m in range(count))
        for _ in range(sweeps):
            for m in range(count):
                rest = total - drift[m][every, code[:, m]]
                code[:, m] = (square[m] + (self.eta - 1) * (rest[:, None] + drift[m]) ** 2).argmin(1)
                total = rest + drift[m][every, code[:, m]]
        return code.astype(np.uint8)

    def _update(self, vectors: np.ndarray, code: np.ndarray) -> None:
        """The centres of least loss for the codes, subspace by subspace."""
        x, along = self._parts(vectors, self.centres.shape[2]), self._directions(vectors)
        width = x.shape[2]
        error = lambda m: ((x[:, m] - self.centres[m][code[:, m]]) * along[:, m]).sum(1)
        total = sum(error(m) for m in range(x.shape[1]))
        for m in range(x.shape[1]):
            rest = total - error(m)
            want = x[:, m] + (self.eta - 1) * (rest + (x[:, m] * along[:, m]).sum(1))[:, None] * along[:, m]
            for c in np.unique(code[:, m]):
                mine = code[:, m] == c
                a = along[mine, m]
                matrix = mine.sum() * np.eye(width) + (self.eta - 1) * a.T @ a
                self.centres[m, c] = np.linalg.solve(matrix, want[mine].sum(0))
            total = rest + error(m)

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        code = self.codes(vectors)
        return code[:, ::2] << 4 | code[:, 1::2]

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products, by tables of two codes at a time."""
        parts = self._parts(queries, self.centres.shape[2])
        tables = np.einsum("qmw,mcw->mqc", parts, self.centres).astype(np.float32)
        out = np.zeros((len(queries), len(packed)), np.float32)
        for j in range(packed.shape[1]):
            both = (tables[2 * j][:, :, None] + tables[2 * j + 1][:, None, :]).reshape(len(queries), -1)
            out += both[:, packed[:, j]]
        return out


def shortlist(scores: np.ndarray, size: int) -> np.ndarray:
    """Columns of the largest scores of each row; ties go to the earlier column."""
    n = scores.shape[1]
    if size >= n:
        return np.broadcast_to(np.arange(n), scores.shape)
    bound = np.partition(scores, n - size, axis=1)[:, n - size, None]
    above, at = scores > bound, scores == bound
    take = above | at & (np.cumsum(at, 1) <= size - above.sum(1, keepdims=True))
    return np.nonzero(take)[1].reshape(len(scores), size)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in order of the dimensions wherever a pair stands."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * vectors[:, d]
    return out


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; no square leaves the range of doubles on the way."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    size = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / size, (largest * size)[:, 0]


def best_pairs(asked: Asked, vectors: np.ndarray, norms: np.ndarray, guess: np.ndarray, open_: np.ndarray, top: int, rerank: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and exact score of all pairs that may be among a query's `top`.

    guess: the scan's inner products of directions; open_: which pairs count; least: scores that
    a newcomer must reach anyway. The shortlist comes first. It shows the score to reach and the
    spread of the scan's errors, which are in proportion to a candidate's norm; every other
    candidate within SLACK of these spreads is reranked, too, so that dense groups with like
    codes aren't cut in the middle. What can't be compared (overflow) is reranked.
    """
    near = guess.astype(np.float64) * norms
    chosen = shortlist(np.where(open_, near, -np.inf), rerank)
    who, at = np.nonzero(np.take_along_axis(open_, chosen, 1))
    which = chosen[who, at]
    score = exact(asked.vectors[who], vectors[which])
    with np.errstate(invalid="ignore", over="ignore"):
        own = score / asked.norms[who]
        error = own / norms[which] - guess[who, which]
        n = np.maximum(np.bincount(who, minlength=len(near)), 1)
        mean = np.bincount(who, error, len(near)) / n
        slack = ROUNDING + SLACK * np.sqrt(np.maximum(np.bincount(who, error**2, len(near)) / n - mean**2, 0))
        held = np.full(chosen.shape, -np.inf)
        held[who, at] = own
        worst = np.partition(held, -top, axis=1)[:, -top] if held.shape[1] >= top else np.full(len(held), -np.inf)
        if least is not None:
            worst = np.maximum(worst, least / asked.norms)
        more = open_ & ~(near + slack[:, None] * norms < worst[:, None])
    np.put_along_axis(more, chosen, False, 1)
    pairs = [(who, which, score)]
    for start in range(0, len(near), 32):
        a, b = np.nonzero(more[start : start + 32])
        pairs.append((a + start, b, exact(asked.vectors[a + start], vectors[b])))
    who, which, score = (np.concatenate(x) for x in zip(*pairs))
    return who, which, score


def copy_rank(vectors: np.ndarray) -> np.ndarray:
    """How many equal vectors stand before each one."""
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.empty(len(vectors), np.int64)
    rank[order] = np.arange(len(vectors)) - np.repeat(first, np.diff(np.append(first, len(vectors))))
    return rank


class Asked:
    """Queries: their ids, vectors, directions and norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.units, self.norms = directions(vectors) if len(vectors) else (vectors, np.zeros(0))

    def part(self, start: int, stop: int) -> Asked:
        out = Asked.__new__(Asked)
        out.ids, out.vectors, out.units, out.norms = self.ids[start:stop], self.vectors[start:stop], self.units[start:stop], self.norms[start:stop]
        return out


class Best:
    """The best `top` candidates so far of some queries: largest score first, then the smaller id."""

    def __init__(self, n: int, top: int):
        self.scores, self.ids, self.used = np.full((n, top), -np.inf), np.zeros((n, top), np.int64), np.zeros((n, top), bool)

    def least(self, start: int, stop: int) -> np.ndarray:
        """What a newcomer must reach; anything while places are free."""
        return np.where(self.used[start:stop, -1], self.scores[start:stop, -1], -np.inf)

    def add(self, start: int, who: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(who)
        if not len(touched):
            return
        old_who, old_at = np.nonzero(self.used[start + touched])
        old_who = touched[old_who]
        old_at = start + old_who, old_at
        who, names, scores = np.concatenate([old_who, who]), np.concatenate([self.ids[old_at], names]), np.concatenate([self.scores[old_at], scores])
        order = np.lexsort((names, -scores, who))
        who, names, scores = who[order], names[order], scores[order]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        keep = rank < self.ids.shape[1]
        at = start + who[keep], rank[keep]
        self.ids[at], self.scores[at], self.used[at] = names[keep], scores[keep], True

    def rows(self, asked: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(0, len(asked), 4096):
            part = slice(i, i + 4096)
            held = zip(self.scores[part].tolist(), self.ids[part].tolist(), self.used[part].sum(axis=1).tolist())
            found = [[{"loss": -s, "vec_id": v} for s, v in zip(a[:n], b)] for a, b, n in held]
            some = [len(x) > 0 for x in found]
            if any(some):
                yield pd.DataFrame({"query_id": asked[part][some], "found": [x for x in found if x]})


def _blocks(rows: Iterator[pd.DataFrame], size: int, model: Quantizer | None) -> Iterator[pd.DataFrame]:
    """Blocks of at most size vectors as raw bytes, in order of their ids."""
    for frame in rows:
        frame = frame.sort_values("vec_id", kind="stable")
        for i in range(0, len(frame), size):
            part = frame.iloc[i : i + size]
            vectors = np.stack(part["vector"].to_numpy()).astype(np.float64)
            out = {"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]}
            if model is not None:
                out["codes"] = [model.packed(directions(vectors)[0]).tobytes()]
                out["copies"] = [copy_rank(vectors).astype("<u4").tobytes()]
            yield pd.DataFrame(out)


def _meet(block: object, asked: Asked, best: Best, start: int, model: Quantizer, top: int, rerank: int) -> None:
    """A block of candidates against some queries, whose best begin at `start`."""
    ids = np.frombuffer(block.ids, np.int64)
    vectors = np.frombuffer(block.vectors).reshape(len(ids), -1)
    guess = model.scan(asked.units, np.frombuffer(block.codes, np.uint8).reshape(len(ids), -1))
    # Of equal vectors only the smaller ids can be among the best, so more copies than that
    # would take places of the shortlist in vain. The query itself may be one.
    open_ = (asked.ids[:, None] != ids) & (np.frombuffer(block.copies, "<u4") <= top)
    who, which, score = best_pairs(asked, vectors, directions(vectors)[1], guess, open_, top, rerank, best.least(start, start + len(asked.ids)))
    best.add(start, who, ids[which], score)


def _search_held(rows: Iterator[pd.DataFrame], queries: Asked, model: Quantizer, top: int, rerank: int, query_block: int) -> Iterator[pd.DataFrame]:
    """All queries against a task's blocks; the best so far are carried from block to block."""
    best = Best(len(queries.ids), top)
    parts = [(i, queries.part(i, i + query_block)) for i in range(0, len(queries.ids), query_block)]
    for frame in rows:
        for block in frame.itertuples(index=False):
            for i, asked in parts:
                _meet(block, asked, best, i, model, top, rerank)
    yield from best.rows(queries.ids)


def _search_met(rows: Iterator[pd.DataFrame], model: Quantizer, top: int, rerank: int) -> Iterator[pd.DataFrame]:
    for frame in rows:
        for row in frame.itertuples(index=False):
            ids = np.frombuffer(row.asked, np.int64)
            asked, best = Asked(ids, np.frombuffer(row.queries).reshape(len(ids), -1)), Best(len(ids), top)
            _meet(row, asked, best, 0, model, top, rerank)
            yield from best.rows(ids)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, one for each id.

    Left out are null ids, vectors that are null or zero or hold null or non-finite components,
    and those that haven't the most frequent length. Of vectors with one id the largest stays.
    """
    x = vectors.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vector", lambda v: v != 0)
    )
    lengths = x.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    x = x.filter(F.size("vector") == (lengths["length"] if lengths else 0))
    return x.groupBy("vec_id").agg(F.max("vector").alias("vector"))


def nearest(vectors: DataFrame, asked: str, key: str = "vec_id", column: str = "embedding", top: int = 20, rerank: int = 256, sample: int = 10_000, block: int = 4096, query_block: int = 256, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The `top` rows of largest inner product for every row that the SQL condition `asked` on vec_id selects.

    Directions are coded and norms kept, so vectors of any magnitude are coded alike well. The
    codes are fitted on at most `sample` vectors, chosen by hash of their id, and every vector
    is coded. Each block of candidates is scanned for blocks of queries by its tables; its best
    `rerank`, and all that could still pass them or the best of the blocks before, get exact
    scores on the original vectors, and the tasks' best are merged in two steps. Queries of at
    most most_broadcast bytes, counted first, are broadcast and nothing but results is
    shuffled; more of them meet teams of blocks by an equi-join. Either way it is a stated set
    of queries against all rows. Returns query_id, rank (from 1), vec_id, score; ties go to the
    smaller vec_id.

    See usable() for rows that take no part; repeated ids count once;
    fewer candidates than `top` give fewer rows; an empty table gives none; further columns are
    ignored. Products beyond the range of doubles are infinite, as in any double arithmetic.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, key, column), "ann-vectors")
    count, n_asked, dims = rows.agg(F.count("*"), F.count_if(F.expr(asked)), F.max(F.size("vector"))).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if not n_asked:
        return spark.createDataFrame([], shape)
    # About twice the sample comes to the sort, whatever the number of partitions.
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= F.lit(int(min(1.0, 2.0 * sample / count + 1e-4) * (1 << 30)))
    drawn = rows.filter(share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    drawn = drawn if len(drawn) else rows.limit(1).toPandas()
    model = spark.sparkContext.broadcast(Quantizer.fit(directions(np.stack(drawn["vector"].to_numpy()).astype(np.float64))[0]))
    lanes = spark.sparkContext.defaultParallelism
    # A small table is dealt out so that every core has some blocks of it; a large one lies in enough files.
    small = count < lanes << 16
    block = max(256, min(block, -(-count // (2 * lanes)))) if small else block
    tasks = -(-count // block)
    spread = rows.repartition(tasks) if small else rows
    held = spread.mapInPandas(lambda x: _blocks(x, block, model.value), "ids binary, vectors binary, codes binary, copies binary")
    held = written(held.withColumn("block", F.xxhash64("ids")), "ann-blocks")
    result = "query_id long, found array<struct<loss: double, vec_id: long>>"
    if n_asked * dims * 8 <= most_broadcast:
        few = rows.filter(asked).toPandas()
        queries = spark.sparkContext.broadcast(Asked(few["vec_id"].to_numpy(np.int64), np.stack(few["vector"].to_numpy()).astype(np.float64)))
        best = (held.repartition(min(tasks, 2 * lanes)) if small else held).mapInPandas(lambda x: _search_held(x, queries.value, model.value, top, rerank, query_block), result)
    else:
        groups = max(lanes, count // 65536)
        queries = rows.filter(asked).coalesce(max(1, count // 65536)).mapInPandas(lambda x: _blocks(x, query_block, None), "ids binary, vectors binary")
        queries = queries.select(F.col("ids").alias("asked"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("team"))
        met = queries.join(held.withColumn("team", F.pmod("block", F.lit(groups))), "team").select("asked", "queries", "ids", "vectors", "codes", "copies")
        best = met.mapInPandas(lambda x: _search_met(x, model.value, top, rerank), result)
    merged = lambda: F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, top).alias("found")
    part = F.pmod(F.xxhash64(F.get("found", F.lit(0))), F.lit(256)).alias("part")
    best = best.groupBy("query_id", part).agg(merged()).groupBy("query_id").agg(merged())
    return best.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.loss")).alias("score"))
