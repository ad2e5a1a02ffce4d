import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keystrata import functions as fn
from keystrata.operators import merge, mvcc, reads, tables
from keystrata.schema import VERSIONED, prefix_end


def v(spark, *rows):
    """(key, seq, value) rows; value None is a tombstone."""
    return spark.createDataFrame([(k.encode() if isinstance(k, str) else k, s, None if x is None else x.encode(), x is None) for k, s, x in rows], VERSIONED)


def pairs(df):
    return [(bytes(r["user_key"]).decode(), r["seq"]) for r in df.select("user_key", "seq").collect()]


def test_unsigned_order(spark):
    keys = [b"\x00", b"\x00\x01", b"\x7f\xff", b"\x80", b"\xff\x00"]
    df = v(spark, *((k, 1, "x") for k in reversed(keys)))
    assert [bytes(r[0]) for r in reads.ordered_dump(df).select("user_key").collect()] == keys


@pytest.mark.parametrize(("snapshot", "want"), [(4, None), (5, "v5"), (6, "v5"), (8, "v8"), (10, "v8"), (11, None), (None, None)])
def test_snapshot_of_versions(spark, snapshot, want):
    row = reads.select(v(spark, ("k", 5, "v5"), ("k", 8, "v8"), ("k", 11, None)), "k", snapshot).first()
    assert (row and bytes(row["value"]).decode()) == want


@pytest.mark.parametrize(("low", "high", "want"), [("b", "d", "bc"), ("c", "z", "cde"), ("b", "b", ""), ("x", "z", ""), ("a", "b", "a")])
def test_scan_bounds(spark, low, high, want):
    df = v(spark, *((k, i + 1, k) for i, k in enumerate("abcde")))
    assert "".join(bytes(r["user_key"]).decode() for r in reads.scan(df, low, high).collect()) == want


def test_bound_before_newest_and_tombstone_after(spark):
    df = v(spark, ("a", 1, "x"), ("a", 9, "y"), ("b", 1, "x"), ("b", 2, None))
    assert pairs(reads.snapshot(df, 5)) == [("a", 1)]
    assert [r["user_key"] for r in reads.snapshot(df, 0).collect()] == []


def test_empty_value_is_a_value(spark):
    assert bytes(reads.select(v(spark, ("k", 1, "")), "k").first()["value"]) == b""


def test_multi_get(spark):
    df = v(spark, ("a", 1, "x"), ("b", 1, "x"), ("b", 2, None))
    got = {bytes(r["user_key"]): r["found"] for r in reads.multi_get(df, spark.createDataFrame([(b"a",), (b"b",), (b"c",), (b"a",)], "user_key binary")).collect()}
    assert got == {b"a": True, b"b": False, b"c": False}


@pytest.mark.parametrize(("floor", "want"), [(6, [9, 6]), (100, [9]), (2, [9, 6, 3])])
def test_gc(spark, floor, want):
    kept = pairs(mvcc.gc_versions(v(spark, ("k", 9, "c"), ("k", 6, "b"), ("k", 3, "a"), ("z", 5, "z")), floor))
    assert sorted((s for k, s in kept if k == "k"), reverse=True) == want and ("z", 5) in kept


@pytest.mark.parametrize(("rows", "floor", "bottom", "want"), [
    ([("d", 8, None), ("d", 4, "old")], 100, False, [8]), ([("d", 8, None), ("d", 4, "old")], 100, True, []), ([("d", 10, None), ("d", 3, "old")], 5, True, [10, 3]),
])
def test_gc_tombstones(spark, rows, floor, bottom, want):
    assert sorted((s for _, s in pairs(mvcc.gc_versions(v(spark, *rows), floor, bottom))), reverse=True) == want


def test_precedence_keeps_tombstone(spark):
    merged = merge.merge_precedence(v(spark, ("gone", 10, None)), v(spark, ("alive", 5, "y"), ("gone", 5, "x")))
    assert sorted(pairs(merged)) == [("alive", 5), ("gone", 10)]


def test_overlay(spark):
    base = spark.createDataFrame([(b"a", b"1"), (b"b", b"2")], "user_key binary, value binary")
    own = spark.createDataFrame([(b"b", None, True), (b"c", b"3", False)], "user_key binary, value binary, deleted boolean")
    assert sorted((bytes(r[0]), bytes(r[1])) for r in merge.overlay(base, own).collect()) == [(b"a", b"1"), (b"c", b"3")]


def test_apply_batch_later_wins(spark):
    held = v(spark, ("k", 1, "old"))
    assert bytes(merge.apply_batch(held, v(spark, ("k", 1, "new"))).first()["value"]) == b"new"


@pytest.mark.parametrize(("key", "want"), [("a", 100), ("c", 100), ("d", 100), ("g", 200), ("m", 300), ("z", 300)])
def test_floor_block(spark, key, want):
    index = spark.createDataFrame([(b"c", 100), (b"f", 200), (b"m", 300)], "first_key binary, block long")
    keys = spark.createDataFrame([(key.encode(),)], "user_key binary")
    assert tables.floor_block(index, keys).first()["block"] == want


RUNS = [(1, 1, b"a", b"c", 10), (2, 1, b"e", b"g", 10), (3, 1, b"m", b"p", 10)]


@pytest.mark.parametrize(("pointer", "want"), [(None, 1), (b"c", 2), (b"g", 3), (b"p", 1)])
def test_round_robin(spark, pointer, want):
    runs = spark.createDataFrame(RUNS, "table_id long, level int, head_key binary, tail_key binary, size long")
    assert tables.round_robin(runs, pointer).first()["table_id"] == want


def test_overlapping_equals_nested_loops(spark):
    rows = [(i, 0, b"%03d" % (i * 7 % 50), b"%03d" % (i * 7 % 50 + i % 9), 1) for i in range(40)]
    runs = spark.createDataFrame(rows, "table_id long, level int, head_key binary, tail_key binary, size long")
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] <= b[3] and b[2] <= a[3]}
    found = [tuple(r) for r in tables.overlapping(runs, runs).collect()]
    assert len(found) == len(want) and set(found) == want


def test_levels(spark):
    runs = spark.createDataFrame([(1, 1, 2000), (2, 2, 11000)], "table_id long, level int, size long")
    scores = tables.level_scores(runs, 4, 1000, 10)
    assert {r["level"]: r["score"] for r in scores.collect()} == {1: 2.0, 2: 1.1}
    assert tables.chosen_level(scores).first()["level"] == 1
    assert tables.chosen_level(scores.filter("score < 1")).first() is None


def test_read_order(spark):
    runs = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2)], "table_id long, level int")
    by = {r["table_id"]: (r["select_rank"], r["scan_rank"]) for r in tables.read_order(runs).collect()}
    assert by == {2: (1, 4), 1: (2, 3), 3: (3, 2), 4: (4, 1)}


@pytest.mark.parametrize(("active", "current", "want"), [([5, 8], 20, 5), ([8], 20, 8), ([], 20, 20), ([7, 7], 30, 7)])
def test_gc_floor(spark, active, current, want):
    assert mvcc.gc_floor(spark.createDataFrame([(x,) for x in active], "snapshot long"), current).first()["floor"] == want


def test_codecs(spark):
    row = spark.range(1).select(
        fn.big_endian(F.lit(258)).alias("be"), fn.internal_seq(fn.encode_internal_key(F.lit(bytearray(b"key")), F.lit(77))).alias("seq"),
        fn.internal_user_key(fn.encode_internal_key(F.lit(bytearray(b"key")), F.lit(77))).alias("key"), fn.fixed_width_key(F.lit(5)).alias("fixed"),
        fn.decode_text(fn.encode_text(F.lit("é"))).alias("text"), fn.spread(F.lit(1), F.lit(2), 100).alias("spread"),
    ).first()
    assert bytes(row["be"]) == (258).to_bytes(8, "big") and row["seq"] == 77 and bytes(row["key"]) == b"key"
    assert bytes(row["fixed"]) == b"key0000000000005" and row["text"] == "é" and row["spread"] == 2 * 3 * 7919 % 100


def test_prefix_end():
    assert prefix_end(b"ab") == b"ac" and prefix_end(b"a\xff") == b"b" and prefix_end(b"\xff") is None


def test_pushdown(spark, tmp_path):
    v(spark, ("a", 1, "x"), ("b", 2, "y")).write.parquet(str(tmp_path / "run"))
    plan = reads.scan(spark.read.parquet(str(tmp_path / "run")), "a", "b", 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_key" in plan and "LessThan(user_key" in plan


def test_first_committer_of_many(spark):
    """A transaction that aborts blocks nobody after it."""
    rng = random.Random(5)
    rows = [("g", "a", 1, b"x"), ("g", "b", 2, b"x"), ("g", "b", 2, b"y"), ("g", "c", 3, b"y"), ("h", "a", 1, b"x"), ("h", "b", 2, b"z"), ("h", "c", 3, b"x"), ("i", "a", 1, None)]
    rows += [("r%d" % g, "t%d" % t, t, b"k%d" % rng.randint(0, 9)) for g in range(5) for t in range(8) for _ in range(rng.randint(1, 3))]
    want, held = {}, {}
    for g, t, _ in sorted({r[:3] for r in rows}, key=lambda r: (r[0], r[2])):
        keys = {r[3] for r in rows if r[:2] == (g, t)} - {None}
        want[g, t] = not keys & held.setdefault(g, set())
        held[g] |= keys if want[g, t] else set()
    got = mvcc.first_committer_wins(spark.createDataFrame(rows, "group string, tx string, commit_order int, user_key binary"))
    assert {(r["group"], r["tx"]): r["committed"] for r in got.collect()} == want
    assert want["g", "a"] and not want["g", "b"] and want["g", "c"] and not want["h", "c"]


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_floor_block_small_and_large(spark, most):
    rng = random.Random(2)
    index = [(b"%04d" % (i * 7), i) for i in range(3, 90)] + [(b"%04d" % 28, 99)]
    keys = [b"%04d" % rng.randint(0, 700) for _ in range(500)] + [b"0100"] * 300 + [b"", b"\xff"]
    firsts = {}
    for k, b in index:
        firsts[k] = min(b, firsts.get(k, b))
    floor = lambda k: firsts[max([f for f in firsts if f <= k], default=min(firsts))]
    got = tables.floor_block(spark.createDataFrame(index, "first_key binary, block int"), spark.createDataFrame([(k,) for k in keys], "user_key binary"), most, 100)
    assert sorted((bytes(r["user_key"]), r["block"]) for r in got.collect()) == sorted((k, floor(k)) for k in keys)
    none = spark.createDataFrame([], "first_key binary, block int")
    assert tables.floor_block(none, spark.createDataFrame([(b"a",)], "user_key binary"), most).collect()[0]["block"] is None


@pytest.mark.parametrize(("rows", "long", "least"), [(1_500_000, 1, 2), (100, 1 << 20, 3)])
def test_key_ranges_follow_the_bytes(spark, rows, long, least):
    """Narrow rows and long values: no task sorts much more than the bytes of a range."""
    log = spark.range(rows).select(
        F.format_string("%09d", F.expr("id * 7919 % 1000003 div 3")).cast("binary").alias("user_key"), F.col("id").alias("seq"),
        F.expr(f"cast(repeat('x', {long}) AS binary)").alias("value"), F.lit(False).alias("deleted"),
    )
    dealt = tables.key_ranges(log, least).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    found = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("user_key").alias("head"), F.max("user_key").alias("tail")).orderBy("part").collect()
    whole = rows * (9 + long + tables.ROW_BYTES)
    assert sum(r["n"] for r in found) == rows and len(found) > least
    assert max(r["n"] for r in found) * whole / rows < 2 * tables.RANGE_BYTES
    assert all(a["tail"] < b["head"] for a, b in zip(found, found[1:]))
    if long == 1:
        w = Window.partitionBy("part").orderBy("at")
        before = dealt.select("user_key", "seq", F.lag("user_key").over(w).alias("k"), F.lag("seq").over(w).alias("s"))
        assert before.filter("k > user_key OR k = user_key AND s < seq").isEmpty()


def test_key_ranges_of_few_rows(spark):
    df = v(spark, ("b", 1, "x"), ("a", 1, "x"), ("a", 2, None))
    assert tables.key_ranges(df, 0, None).rdd.getNumPartitions() == 1
    assert pairs(tables.key_ranges(df, 1)) == [("a", 2), ("a", 1), ("b", 1)]
    assert pairs(tables.key_ranges(df, 1, 1)) == [("a", 2), ("a", 1), ("b", 1)]
    assert tables.key_ranges(df.limit(0), 0).collect() == []
