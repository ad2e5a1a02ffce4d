import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from keystrata.llm.line_dedup import BLANK, ORACLE, LineRuns, drop_repeated_lines, sorted_buckets


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(docs, least=20, enough=3):
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least:
                held[key_of(line)].add(i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held.get(key_of(x), ())) < enough or max(held[key_of(x)]) == i]
        out[i] = len(lines), len(lines) - len(stay), "\n".join(stay)
    return out


def found(df, **more):
    return {r["doc_id"]: tuple(r)[1:] for r in drop_repeated_lines(df, **more).collect()}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_against_brute_force(docs, batches):
    rng = random.Random(batches)
    pool = [f"line {i} of the shared pool É" + "x" * rng.randint(0, 9) for i in range(25)] + ["short", "", "twenty chars exactly", "nineteen characters"]
    vary = lambda s: rng.choice([s, s.upper(), f"  {s}\t", f"{s}\r", s + "\u00a0"])
    rows = [(rng.randint(0, 10**6), "\n".join(vary(rng.choice(pool)) for _ in range(rng.randint(0, 9)))) for _ in range(120)]
    rows = list(dict(rows).items()) + [(-1, None), (-2, ""), (-3, "\n\n"), (-4, "\n".join([pool[0]] * 3))]
    assert found(docs(*rows), batches=batches) == brute(rows)


def test_keeper_keeps_all_its_lines(docs):
    line = "the very same line of text"
    got = found(docs((1, line), (2, f"{line}\n{line}\nown"), (9, f"{line}\n{line}")))
    assert got == {1: (1, 1, ""), 2: (3, 2, "own"), 9: (2, 0, f"{line}\n{line}")}


def test_null_keys_repeats_and_empty(docs):
    line = "the very same line of text"
    rows = drop_repeated_lines(docs((None, line), (1, line), (1, line), (2, line))).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 0)]
    assert drop_repeated_lines(docs()).collect() == []


LINES = "doc_key long, h1 long, h2 long"


def test_runs_compact(spark):
    runs = LineRuns(4, 3, fanout=2)
    for i in (9, 6, 3):
        runs.add(spark.createDataFrame([(i, 1, 1), (i, i, 2)], LINES))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert {tuple(r) for run in runs.runs() for r in run.collect()} == {(1, 1, 2), (9, 2, 1), (6, 2, 1), (1, 1, 1), (3, 2, 1)}
    assert {tuple(r) for r in runs.decisions().collect()} == {(1, 1, 0, 9), (1, 1, 1, None), (1, 1, 2, None)}
    runs.add(spark.createDataFrame([(2, 1, 1)], LINES))
    assert runs.judged[-1].first()["decided"] and sum(run.filter("h1 = 1").count() for run in runs.runs()) == 1


def test_the_merge_decides(docs, monkeypatch):
    """Without the join each batch would keep a line of its own."""
    line = "the very same line of text"
    rows = docs(*((i, line) for i in range(40)))
    assert sum(n for _, n, _ in found(rows).values()) == 39
    monkeypatch.setattr(LineRuns, "seen", lambda _, own: own.withColumn("before", F.lit(None).cast("long")))
    assert sum(n for _, n, _ in found(rows).values()) == 36


def test_runs_are_neither_moved_nor_sorted(spark):
    runs = LineRuns(4, 3)
    for i in (9, 6):
        runs.add(spark.range(1000).select((F.lit(i) + F.col("id")).alias("doc_key"), (F.col("id") % 50 + i).alias("h1"), F.col("id").alias("h2")))
    own = spark.range(1000).select((F.col("id") % 50).alias("h1"), F.col("id").alias("h2")).repartition(4, "h1", "h2")
    with sorted_buckets(spark):
        plan = runs.seen(own)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_very_long_text_and_shuffled_decisions(docs):
    rows = [(1, "\n".join(f"line number {i} of a long text" for i in range(60_000))), (2, "line number 7 of a long text"), (3, "x\nLINE number 7 of a long text"), (4, "a" * 5_000_000)]
    assert found(docs(*rows), most_broadcast=0) == brute(rows)


def test_sql_agrees(docs, tmp_path):
    rows = [(i, "\n".join(f"{'  ' * (i % 3)}Repeated line number {j % (i + 2)}" for j in range(i))) for i in range(30)] + [(99, None), (98, "")]
    docs(*rows).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {i: (n, gone, sha) for i, n, gone, sha in c.execute(ORACLE).fetchall()}
    assert {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in found(docs(*rows)).items()} == want
