import hashlib
import random
import re

import duckdb
import pytest

from keystrata.llm.decontaminate import ORACLE, benchmark_hits


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=8):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= got
        out[i] = len(w), len(hit), sorted(found)
    return out


def frame(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")


@pytest.mark.parametrize("short", [False, True])
def test_against_brute_force(spark, docs, short):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(30)] + ["é", "ß1", "日本"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(8, 30)))) for i in range(20)] + [(50, None), (51, " - "), (100, items_tail())]
    if short:
        items += [(60, "w1 w2 w3"), (61, "W5"), (62, "w1, w2; w3")]
    rows = []
    for i in range(60):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w = words(rng.choice(items[:20])[1])
            a = rng.randint(0, len(w) - 8)
            text[len(text) // 2 : len(text) // 2] = w[a : a + rng.choice([7, 8, 9, 20])]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper() if i % 2 else " ".join(text)))
    rows += [(70, None), (71, ""), (72, items_tail())]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in benchmark_hits(docs(*rows), frame(spark, items)).collect()}
    assert got == brute(rows, items)


def items_tail():
    return "same same same same same same same same same same"


def test_repeats_null_keys_and_empty(spark, docs):
    items = frame(spark, [(1, items_tail())])
    rows = benchmark_hits(docs((1, items_tail()), (1, items_tail()), (None, items_tail()), (1, "other")), items).collect()
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in rows) == [(0, 10), (1, 0), (1, 10), (1, 10)]
    assert benchmark_hits(docs(), items).collect() == []
    row = benchmark_hits(docs(items_tail()), frame(spark, [])).first()
    assert (row["n_words"], row["n_hit"], row["items"], row["full_items"]) == (10, 0, [], [])


def test_very_long_text(spark, docs):
    item = " ".join(f"q{i}" for i in range(12))
    filler = " ".join(f"w{i}" for i in range(150_000))
    rows = benchmark_hits(docs((1, f"{filler} {item} {filler}"), (2, "y" * 2_000_000), (3, filler)), frame(spark, [(1, item)])).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in rows} == {1: (300_012, 12), 2: (1, 0), 3: (150_000, 0)}


def test_sql_agrees(spark, docs, tmp_path):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(8)] + [(50, None), (51, "...")]
    rows = [(i, " ".join(rng.choice(pool).upper() for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(90, None), (91, "")]
    docs(*rows).write.parquet(str(tmp_path / "d"))
    frame(spark, items).write.parquet(str(tmp_path / "b"))
    c = duckdb.connect()
    for name, folder in (("documents", "d"), ("benchmark", "b")):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{folder}/*.parquet'")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), len(r["items"]) >= 2) for r in benchmark_hits(docs(*rows), frame(spark, items)).collect()}
    assert got == set(c.execute(ORACLE).fetchall())
