import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keystrata.llm import mixing


def rows_of(n=400):
    rng = random.Random(6)
    return [(i, "word " * rng.randint(1, 40) + rng.choice(["x", "Y | z", "1234567", "***"]), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b"])) for i in range(n)]


def shares(rows, by):
    total = {}
    for r in rows:
        total[r[by]] = total.get(r[by], 0) + r["n_tokens"] * r["factor"]
    whole = sum(total.values())
    return {k: v / whole for k, v in total.items()}


def spark_hash(*values):
    """Spark's xxhash64 of an int (in a tuple), longs and strings; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v) if isinstance(v, int) else v.encode()
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute(rows, model, targets=None, power=0.9, rounds=200, seed=17):
    """doc_id to factor, probability and kept, in plain Python; rows of doc_id, text, lang, source."""
    cell, tokens = {}, {}
    for i, (_, text, lang, source) in enumerate(rows):
        cell[i] = source or "unknown", lang or "unknown", model.of([text])[0]
        n = max(1, len([w for w in re.split("[ \\t\\n\\x0b\\x0c\\r]+", text or "") if w]))
        tokens[cell[i]] = tokens.get(cell[i], 0) + n
    factor, share = dict.fromkeys(tokens, 1.0), []
    for m, name in enumerate(mixing.MARGINS):
        own = {}
        for c, n in tokens.items():
            own[c[m]] = own.get(c[m], 0) + n
        raised = dict((targets or {}).get(name) or {k: v**power for k, v in own.items()})
        share.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(rounds):
        worst = 0.0
        for m in range(3):
            now = {}
            for c, n in tokens.items():
                now[c[m]] = now.get(c[m], 0.0) + n * factor[c]
            total = sum(now.values())
            worst = max(worst, *(abs(now[k] / total - share[m].get(k, 0.0)) for k in now))
            for c in factor:
                factor[c] *= share[m].get(c[m], 0.0) * total / now[c[m]] if now[c[m]] else 0.0
        if worst <= 1e-9:
            break
    out, whole = [], sum(tokens.values())
    scale = max([factor[c] for c in factor if tokens[c] >= 1e-3 * whole] or factor.values())
    for i, (doc_id, text, _, _) in enumerate(rows):
        p = min(1.0, factor[cell[i]] / scale)
        draw = ((spark_hash((seed,), doc_id, spark_hash(text)) & (1 << 64) - 1) >> 11) / (1 << 53)
        out.append((doc_id, *cell[i], factor[cell[i]], p, draw < p))
    return out


@pytest.mark.parametrize("targets", [None, {"source": {"a": 1, "b": 2}, "lang": {"en": 0.5, "de": 0.3, "unknown": 0.2}}])
def test_against_brute_force(spark, docs, targets):
    rows = rows_of(200) + [(900, None, "en", "a"), (901, "", None, None), (900, "again", "en", "a"), (None, "no key", "de", "b")]
    model = mixing.fit_topics(docs(*rows))
    want = brute(rows, model, targets)
    got = mixing.mix(docs(*rows), targets=targets).collect()
    order = lambda x: str(x[:4]) + f"{x[5]:.6f}"
    got = sorted(((r["doc_id"], r["source"], r["lang"], r["topic"], r["factor"], r["probability"], r["kept"]) for r in got), key=order)
    for x, y in zip(got, sorted(want, key=order), strict=True):
        assert x[:4] == y[:4] and x[4:6] == pytest.approx(y[4:6], rel=1e-6) and x[6] == y[6]
    left = mixing.sample(docs(*rows), targets=targets)
    assert left.columns == docs().columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted((x[0] or 0, r[1] or "") for x, r in zip(want, rows) if x[6])


def test_margins_meet_their_targets(docs):
    targets = {"source": {"a": 1, "b": 1}, "lang": {"en": 0.5, "de": 0.3, "unknown": 0.2}}
    found = mixing.mix(docs(*rows_of()), targets=targets).collect()
    assert shares(found, "source") == pytest.approx({"a": 0.5, "b": 0.5}, abs=1e-6)
    assert shares(found, "lang") == pytest.approx(targets["lang"], abs=1e-6)
    own = {}
    for r in found:
        own[r["topic"]] = own.get(r["topic"], 0) + r["n_tokens"]
    assert shares(found, "topic") == pytest.approx(mixing.tempered(own, 0.9), abs=1e-6)
    assert max(r["probability"] for r in found) == 1 and all(r["kept"] for r in found if r["probability"] == 1)


def test_a_small_cell_does_not_set_the_scale(docs):
    """One rare document whose factor is large is kept, and the others aren't thinned out for it."""
    rows = [(i, "plain words of the corpus " * 20, "en" if i % 2 else "de", "a") for i in range(400)] + [(900, "x", "fr", "b")]
    targets = {"source": {"a": 0.99, "b": 0.01}, "lang": {"en": 0.5, "de": 0.49, "fr": 0.01}}
    got = {r["doc_id"]: r for r in mixing.mix(docs(*rows), topic=F.lit("t"), targets=targets).collect()}
    assert got[900]["probability"] == 1 and got[900]["factor"] > 10 * got[1]["factor"] and sum(r["kept"] for r in got.values()) > 380
    thin = mixing.mix(docs(*rows), topic=F.lit("t"), targets=targets, scale_share=0.0).collect()
    assert sum(r["kept"] for r in thin) < 100


def test_raking_as_a_table_is_the_same(docs):
    rows = docs(*rows_of(150))
    a, b = (sorted((r["doc_id"], r["factor"], r["kept"]) for r in mixing.mix(rows, rounds=4, most_cells=most).collect()) for most in (1 << 18, 0))
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b], rel=1e-9) and [x[2] for x in a] == [x[2] for x in b]


def test_topics_part_vocabularies(docs):
    rng = random.Random(3)
    kinds = [[f"{c}{i}" for i in range(40)] for c in ("sea", "law", "cook")]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(60))) for i in range(90)]
    found = {r["doc_id"]: r["topic"] for r in mixing.mix(docs(*rows), topics=3).collect()}
    assert len(set(found.values())) == 3 and all(len({found[i] for i in range(k, 90, 3)}) == 1 for k in range(3))
    few = mixing.fit_topics(docs(*rows), number=3, sample=20)
    assert len(few.centres) == 3 and len({few.of([text])[0] for _, text in rows}) == 3


def test_given_topic_and_long_text(docs):
    got = mixing.mix(docs((1, "w " * 4_000_000, "en", "a"), (2, "b", "en", "a")), topic=F.col("key")).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == {(1, 4_000_000), (2, 1)} and {r["topic"] for r in got} == {docs((1, "b")).first()["key"] or "unknown"}


def test_sample_follows_the_probabilities(docs):
    found = mixing.mix(docs(*rows_of(3000)), targets={"source": {"a": 0.3, "b": 0.7}}).collect()
    assert abs(sum(r["kept"] for r in found) - sum(r["probability"] for r in found)) < 120
    assert {r["doc_id"]: r["kept"] for r in mixing.mix(docs(*rows_of(3000)), targets={"source": {"a": 0.3, "b": 0.7}}).collect()} == {r["doc_id"]: r["kept"] for r in found}


def test_edges(docs):
    assert mixing.mix(docs()).collect() == []
    rows = {r["doc_id"]: r for r in mixing.mix(docs((1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"))).collect()}
    assert rows[1]["n_tokens"] == 1 and rows[1]["topic"] == "none" and rows[3]["n_tokens"] == 3 and rows[3]["source"] == "unknown" and len(rows) == 4
    only = mixing.mix(docs((1, "a", "en", "s"), (2, "a", "en", "t")), targets={"source": {"s": 1}}).collect()
    assert {r["doc_id"]: r["kept"] for r in only} == {1: True, 2: False}


def test_rake_known():
    factor = mixing.rake(np.array([1.0, 1, 1, 1]), np.array([[0, 0], [0, 1], [1, 0], [1, 1]]), [np.array([0.8, 0.2]), np.array([0.5, 0.5])], 50, 1e-12)
    assert factor / factor.sum() == pytest.approx([0.4, 0.4, 0.1, 0.1])


def test_tokens_are_runs_of_non_white_space(docs):
    found = mixing.mix(docs((1, "one\nword\na\nline"), (2, "two  blanks "), (3, "a\tb\r\nc"), (4, " \n "))).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {1: 4, 2: 2, 3: 3, 4: 1}


def topics_of_all(texts, number=8, dims=512, rounds=12):
    """Weights and centres of every text in memory, in floating point."""
    held = np.array([np.bincount((w % np.uint64(dims)).astype(np.int64), minlength=dims) for w in mixing.word_hashes(texts)], float)
    marks = np.array([spark_hash(t) for t in texts])[held.sum(axis=1) > 0]
    held = held[held.sum(axis=1) > 0]
    weights = np.log((1 + len(held)) / (1 + (held > 0).sum(axis=0))) + 1
    x = np.log1p(held) * weights
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen = [int(marks.argmin())]
    while len(chosen) < number:
        near = (x @ x[chosen].T).max(axis=1).round(9)
        chosen.append(int(np.lexsort((marks, near))[0]))
    centres = x[chosen]
    for _ in range(rounds):
        topic = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[topic == i].sum(axis=0) for i in range(number)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    size = np.bincount((x @ centres.T).argmax(axis=1), minlength=number)
    return weights, centres[np.argsort(-size, kind="stable")]


def many_texts(n=6000):
    rng = random.Random(5)
    kinds = [[f"{c}{i}" for i in range(30)] for c in ("sea", "law", "cook", "rail", "star")]
    return [" ".join(rng.choices(kinds[i % 5], k=rng.randint(3, 12))) + f" n{i}" for i in range(n)] + ["", None]


def test_topics_learn_from_every_text(docs):
    """More texts than a sample of 4,096 would hold, however their rows are dealt out."""
    texts = many_texts()
    weights, centres = topics_of_all([t or "" for t in texts])
    model = mixing.fit_topics(docs(*texts))
    assert model.weights == pytest.approx(weights, rel=1e-6)
    assert model.centres / np.linalg.norm(model.centres, axis=1, keepdims=True) == pytest.approx(centres, abs=1e-5)
    other = mixing.fit_topics(docs(*texts).repartition(7))
    assert (other.weights == model.weights).all() and (other.centres == model.centres).all()
