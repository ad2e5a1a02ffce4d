"""Every operator as a query over the sample tables, with the same query in SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata import fixtures as fx
from keystrata.config import StoreConfig
from keystrata.functions import checksum, encoded_entry_bytes, entry_bytes
from keystrata.operators import merge, mvcc, reads, tables
from keystrata.schema import readable, to_binary
from keystrata.sources.manifest import describe, runs_df
from keystrata.storage import new_path
from keystrata.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A floor above every seq.
FAR = 1 << 62
LOW, HIGH = "user000003", "user000060"
#: Rows of a run, and the settings of the level queries.
RUN_ROWS, TRIGGER, BASE, MULTIPLIER = 256, 4, 4096, 10

#: newest(t): one row a key of a CTE t, tombstones included.
NEWEST = "SELECT k, seq, v, deleted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM {0}) WHERE rn = 1"
#: Half of the largest seq, for snapshots and floors that grow with the log; 0 in an empty one.
HALF = "(SELECT coalesce(max(seq), 0) // 2 FROM events_log)"
RUNS = f"SELECT (seq - 1) // {RUN_ROWS} table_id, ((seq - 1) // {RUN_ROWS}) % 3 level, min(k) head_key, max(k) tail_key, max(seq) max_seq, min(seq) min_seq, count(*) n_rows, CAST(sum(length(k) + coalesce(octet_length(encode(v)), 0)) AS bigint) size FROM events_log GROUP BY ALL"


def query(sql: str | None, *views: str, **ctes: str):
    """Registers a query and its SQL over the named views and further CTEs."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [f"{name} AS ({fx.SQL[name]})" for name in views] + [f"{name} AS ({body})" for name, body in ctes.items()]
            ORACLES[f.__name__] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return f

    return register


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.events_log(spark, sf_dir).withColumn("table_id", F.floor((F.col("seq") - 1) / RUN_ROWS).cast("long"))
    return tables.run_stats(v.withColumn("level", (F.col("table_id") % 3).cast("int")), "table_id", "level")


def _half(v: DataFrame) -> int:
    return (v.agg(F.max("seq")).first()[0] or 0) // 2


def _text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


@query("SELECT count(*) n, CAST(coalesce(sum(octet_length(encode(v))), 0) AS bigint) value_bytes FROM orders_kv WHERE k >= 'key0000000000100' AND k < 'key0000000001000'", "orders_kv")
def range_value_bytes(spark, sf_dir):
    held = reads.scan(fx.orders_kv(spark, sf_dir), "key0000000000100", "key0000000001000")
    return held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("value_bytes"))


@query("SELECT k, v FROM n WHERE k = 'user000007' AND NOT deleted", "events_log", n=NEWEST.format("events_log"))
def point_select(spark, sf_dir):
    return readable(reads.select(fx.events_log(spark, sf_dir), "user000007").select("user_key", "value"))


@query("SELECT a.k, n.v, n.k IS NOT NULL found FROM (SELECT printf('user%06d', c_custkey) k FROM customer) a LEFT JOIN (SELECT * FROM n WHERE NOT deleted) n USING (k)", "events_log", n=NEWEST.format("events_log"))
def multi_get(spark, sf_dir):
    """Every customer's key."""
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("user%06d", "c_custkey").cast("binary").alias("user_key"))
    return readable(reads.multi_get(fx.events_log(spark, sf_dir), asked))


@query(f"SELECT k, v FROM n WHERE k >= '{LOW}' AND k < '{HIGH}' AND NOT deleted", "events_log", n=NEWEST.format("events_log"))
def scan_range(spark, sf_dir):
    return readable(reads.scan(fx.events_log(spark, sf_dir), LOW, HIGH))


@query("SELECT k, v FROM n WHERE k LIKE '00000001%' AND NOT deleted", "lineitem_log", n=NEWEST.format("lineitem_log"))
def prefix_scan(spark, sf_dir):
    return readable(reads.prefix_scan(fx.lineitem_log(spark, sf_dir), "00000001"))


@query(f"SELECT count(*) n FROM n WHERE k >= '{LOW}' AND k < '{LOW}'", "events_log", n=NEWEST.format("events_log"))
def scan_empty_range(spark, sf_dir):
    return reads.scan(fx.events_log(spark, sf_dir), LOW, LOW).agg(F.count("*").alias("n"))


@query("SELECT k, seq, v FROM n WHERE NOT deleted", "events_log", b=f"SELECT * FROM events_log WHERE seq <= {HALF}", n=NEWEST.format("b"))
def snapshot_as_of(spark, sf_dir):
    v = fx.events_log(spark, sf_dir)
    return readable(reads.snapshot(v, _half(v)))


@query("SELECT count(*) n FROM events_log WHERE seq <= 0", "events_log")
def snapshot_before_any(spark, sf_dir):
    return reads.snapshot(fx.events_log(spark, sf_dir), 0).agg(F.count("*").alias("n"))


@query("SELECT * FROM n", "events_log", b=f"SELECT * FROM events_log WHERE seq <= {HALF}", n=NEWEST.format("b"))
def newest_including_tombstones(spark, sf_dir):
    v = fx.events_log(spark, sf_dir)
    return readable(reads.newest_per_key(reads.as_of(v, _half(v))))


@query("SELECT k, seq, v FROM n WHERE NOT deleted", "events_log", n=NEWEST.format("events_log"))
def live_snapshot(spark, sf_dir):
    return readable(reads.snapshot(fx.events_log(spark, sf_dir)))


@query("SELECT k, seq FROM n WHERE deleted", "events_log", n=NEWEST.format("events_log"))
def tombstoned_keys(spark, sf_dir):
    return readable(reads.newest_per_key(fx.events_log(spark, sf_dir)).filter("deleted").select("user_key", "seq"))


@query("SELECT * FROM n", "lineitem_log", n=NEWEST.format("lineitem_log"))
def newest_of_many_keys(spark, sf_dir):
    return readable(reads.newest_per_key(fx.lineitem_log(spark, sf_dir)))


@query("SELECT k, max(seq) seq FROM lineitem_log GROUP BY k", "lineitem_log")
def latest_seq_per_key(spark, sf_dir):
    return readable(reads.latest_seq(fx.lineitem_log(spark, sf_dir)))


@query("SELECT k, greatest(coalesce(p.seq, 0), coalesce(s.seq, 0)) seq FROM p FULL JOIN s USING (k)", "events_log", p="SELECT k, max(seq) seq FROM events_log WHERE seq > 900 GROUP BY k", s="SELECT k, max(seq) seq FROM events_log WHERE seq <= 900 GROUP BY k")
def merged_latest_seq(spark, sf_dir):
    v = fx.events_log(spark, sf_dir)
    return readable(merge.merged_latest_seq(v.filter("seq > 900"), v.filter("seq <= 900")))


@query("SELECT * FROM hi UNION ALL SELECT * FROM lo WHERE k NOT IN (SELECT k FROM hi)", "events_log", a=f"SELECT * FROM events_log WHERE seq <= {HALF}", b=f"SELECT * FROM events_log WHERE seq > {HALF}", lo=NEWEST.format("a"), hi=NEWEST.format("b"))
def merge_precedence(spark, sf_dir):
    """The whole late half of the log over the whole early half."""
    v = fx.events_log(spark, sf_dir)
    half = _half(v)
    return readable(merge.merge_precedence(reads.newest_per_key(v.filter(f"seq > {half}")), reads.newest_per_key(v.filter(f"seq <= {half}"))))


@query("SELECT k, seq, v FROM n WHERE NOT deleted", "events_log", n=NEWEST.format("events_log"))
def three_source_scan(spark, sf_dir):
    v = fx.events_log(spark, sf_dir)
    return readable(merge.merged_snapshot(v.filter("seq <= 300"), v.filter("seq > 300 AND seq <= 700"), v.filter("seq > 700")))


@query("SELECT seq, k, v, deleted FROM f", "tx_log", f="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq, k ORDER BY ord DESC) rn FROM tx_log) WHERE rn = 1")
def write_set_fold(spark, sf_dir):
    return readable(merge.fold_write_set(fx.tx_log(spark, sf_dir), "seq"))


@query("SELECT k, v FROM f WHERE NOT deleted UNION ALL SELECT k, v FROM n WHERE NOT deleted AND k NOT IN (SELECT k FROM f)", "events_log", "tx_log", b=f"SELECT * FROM events_log WHERE seq <= {HALF}", n=NEWEST.format("b"), f="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord DESC) rn FROM tx_log WHERE seq = 60) WHERE rn = 1")
def tx_overlay_read(spark, sf_dir):
    v = fx.events_log(spark, sf_dir)
    own = merge.fold_write_set(fx.tx_log(spark, sf_dir).filter("seq = 60"))
    return readable(merge.overlay(reads.snapshot(v, _half(v)), own))


@query("SELECT DISTINCT f.k FROM f JOIN events_log e ON e.k = f.k AND e.seq > 590", "events_log", "tx_log", f="SELECT DISTINCT k FROM tx_log WHERE seq = 60")
def write_set_conflicts(spark, sf_dir):
    own = merge.fold_write_set(fx.tx_log(spark, sf_dir).filter("seq = 60"))
    return readable(mvcc.conflicts(own, fx.events_log(spark, sf_dir), 590))


@query("SELECT t.seq, bool_or(EXISTS (SELECT 1 FROM u WHERE u.k = t.k AND u.seq < t.seq AND u.seq > t.snapshot_seq)) conflicted FROM u t GROUP BY t.seq", "tx_log", u="SELECT DISTINCT seq, snapshot_seq, k FROM tx_log")
def tx_conflicts(spark, sf_dir):
    return mvcc.transaction_conflicts(fx.tx_log(spark, sf_dir).select("seq", "snapshot_seq", "user_key").distinct())


@query("SELECT g AS \"group\", tx, committed FROM f", "tx_log", a="SELECT (seq - 1) // 10 g, seq tx, (seq - 1) % 10 + 1 o, list(DISTINCT k) ks FROM tx_log GROUP BY seq",
       f="WITH RECURSIVE r AS (SELECT g, o, tx, ks held, true committed FROM a WHERE o = 1 UNION ALL SELECT a.g, a.o, a.tx, CASE WHEN list_has_any(r.held, a.ks) THEN r.held ELSE list_concat(r.held, a.ks) END, NOT list_has_any(r.held, a.ks) FROM r JOIN a ON a.g = r.g AND a.o = r.o + 1) SELECT g, tx, committed FROM r")
def first_committer_wins(spark, sf_dir):
    """Ten transactions a group, all at one snapshot."""
    t = fx.tx_log(spark, sf_dir).select(F.expr("(seq - 1) div 10").alias("group"), F.col("seq").alias("tx"), ((F.col("seq") - 1) % 10 + 1).alias("commit_order"), "user_key")
    return mvcc.first_committer_wins(t)


@query("SELECT k, count(*) versions FROM lineitem_log GROUP BY k", "lineitem_log")
def version_count_per_key(spark, sf_dir):
    return readable(reads.version_counts(fx.lineitem_log(spark, sf_dir)))


@query("SELECT k, seq, lead(seq) OVER (PARTITION BY k ORDER BY seq) until_seq FROM events_log", "events_log")
def version_validity(spark, sf_dir):
    return readable(reads.validity(fx.events_log(spark, sf_dir)).select("user_key", "seq", "until_seq"))


def _gc_sql(floor: int | str, drop: bool = False) -> str:
    kept = " AND NOT deleted" if drop else ""
    return f"SELECT k, seq, v, deleted FROM events_log WHERE seq > {floor} UNION ALL SELECT k, seq, v, deleted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM events_log WHERE seq <= {floor}) WHERE rn = 1{kept}"


@query(_gc_sql(HALF), "events_log")
def gc_floor_mid(spark, sf_dir):
    v = fx.events_log(spark, sf_dir)
    return readable(mvcc.gc_versions(v, _half(v)))


@query(_gc_sql(FAR), "events_log")
def gc_floor_max(spark, sf_dir):
    return readable(mvcc.gc_versions(fx.events_log(spark, sf_dir), FAR))


@query(_gc_sql(0), "events_log")
def gc_floor_zero(spark, sf_dir):
    return readable(mvcc.gc_versions(fx.events_log(spark, sf_dir), 0))


@query(_gc_sql(HALF, True), "events_log")
def gc_drop_tombstones_bottom(spark, sf_dir):
    v = fx.events_log(spark, sf_dir)
    return readable(mvcc.gc_versions(v, _half(v), drop_tombstones=True))


def _reclaimed(v: DataFrame, floor: int) -> DataFrame:
    after = mvcc.gc_versions(v, floor, drop_tombstones=True).select(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    both = after.unionByName(v.select(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).agg(F.sum("a").alias("before"), F.sum("b").alias("after"))
    return both.withColumn("reclaimed", F.col("before") - F.col("after"))


@query("SELECT (SELECT count(*) FROM events_log) before, (SELECT count(*) FROM g) after, (SELECT count(*) FROM events_log) - (SELECT count(*) FROM g) reclaimed", "events_log", g=_gc_sql(HALF, True))
def gc_reclaimed_stats(spark, sf_dir):
    v = fx.events_log(spark, sf_dir)
    return _reclaimed(v, _half(v))


@query("SELECT least(min(last), max(last)) floor FROM (SELECT max(event_id) + 1 AS last FROM events GROUP BY user_id)")
def gc_floor_of_readers(spark, sf_dir):
    """Every user reads at their last event."""
    active = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg((F.max("event_id") + 1).alias("snapshot"))
    return mvcc.gc_floor(active, active.agg(F.max("snapshot")).first()[0] or 0)


@query("SELECT event_id % 5 AS snapshot, count(*) readers FROM events GROUP BY ALL")
def active_snapshot_counts(spark, sf_dir):
    return mvcc.active_counts(spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 5).alias("snapshot")))


@query("SELECT table_id, head_key, tail_key, max_seq, min_seq, n_rows, size FROM r", "events_log", r=RUNS)
def run_stats(spark, sf_dir):
    return _text(_runs(spark, sf_dir).drop("level"), "head_key", "tail_key")


@query("SELECT CAST(sum(octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0)) AS bigint) bytes FROM events_log", "events_log")
def memtable_bytes(spark, sf_dir):
    return fx.events_log(spark, sf_dir).agg(F.sum(entry_bytes(F.col("user_key"), F.col("value"))).alias("bytes"))


@query("SELECT CAST(sum(octet_length(encode(k)) + 24 + CASE WHEN deleted THEN 8 ELSE octet_length(encode(v)) + 16 END) AS bigint) bytes FROM events_log", "events_log")
def encoded_bytes(spark, sf_dir):
    return fx.events_log(spark, sf_dir).agg(F.sum(encoded_entry_bytes(F.col("user_key"), F.col("value"), F.col("deleted"))).alias("bytes"))


LEVELS = f"SELECT level, count(*) tables, CAST(sum(size) AS bigint) bytes, CASE WHEN level = 0 THEN count(*) / {TRIGGER}.0::double ELSE sum(size)::double / ({BASE}.0::double * pow({MULTIPLIER}, level - 1)) END score FROM r GROUP BY level"


@query("SELECT CAST(level AS integer) AS level, tables, bytes, round(score, 6) score FROM s", "events_log", r=RUNS, s=LEVELS)
def level_bytes_scores(spark, sf_dir):
    return tables.level_scores(_runs(spark, sf_dir), TRIGGER, BASE, MULTIPLIER).withColumn("score", F.round("score", 6))


@query("SELECT CAST(level AS integer) AS level FROM s WHERE score >= 1 ORDER BY score DESC, level DESC LIMIT 1", "events_log", r=RUNS, s=LEVELS)
def compaction_level(spark, sf_dir):
    return tables.chosen_level(tables.level_scores(_runs(spark, sf_dir), TRIGGER, BASE, MULTIPLIER))


@query("SELECT CAST(max(level) AS integer) AS level FROM r", "events_log", r=RUNS)
def deepest_level(spark, sf_dir):
    return tables.deepest_level(_runs(spark, sf_dir))


@query("SELECT CAST(level AS integer) AS level, min(head_key) head_key, max(tail_key) tail_key FROM r GROUP BY level", "events_log", r=RUNS)
def level_ranges(spark, sf_dir):
    return _text(tables.level_range(_runs(spark, sf_dir)), "head_key", "tail_key")


ORDER_RUNS = "SELECT o_orderkey // 100 table_id, min(printf('key%013d', o_orderkey)) head_key, max(printf('key%013d', o_orderkey + 150)) tail_key FROM orders GROUP BY ALL"


def _order_runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.expr("o_orderkey div 100").alias("table_id")).agg(
        F.min(F.format_string("key%013d", "o_orderkey")).cast("binary").alias("head_key"), F.max(F.format_string("key%013d", F.col("o_orderkey") + 150)).cast("binary").alias("tail_key"),
    )


@query("SELECT a.table_id a_id, b.table_id b_id FROM r a JOIN r b ON a.head_key <= b.tail_key AND b.head_key <= a.tail_key", r=ORDER_RUNS)
def overlapping_tables(spark, sf_dir):
    runs = _order_runs(spark, sf_dir)
    return tables.overlapping(runs, runs)


@query("SELECT table_id FROM r WHERE head_key < 'key0000000000700' AND tail_key >= 'key0000000000420'", r=ORDER_RUNS)
def scan_pruned_tables(spark, sf_dir):
    return tables.pruned(_order_runs(spark, sf_dir), "key0000000000420", "key0000000000700").select("table_id")


@query("SELECT table_id, p FROM (SELECT table_id, 'after' p FROM r WHERE head_key > 'key0000000000700' ORDER BY head_key LIMIT 1) UNION ALL SELECT table_id, 'wrapped' p FROM (SELECT table_id FROM r ORDER BY head_key LIMIT 1)", r=ORDER_RUNS)
def round_robin_pick(spark, sf_dir):
    runs = _order_runs(spark, sf_dir)
    pick = lambda pointer, name: tables.round_robin(runs, pointer).select("table_id", F.lit(name).alias("p"))
    return pick(b"key0000000000700", "after").unionByName(pick(b"z", "wrapped"))


@query("SELECT o.k, coalesce(i.block, (SELECT min(block) FROM i)) block FROM o ASOF LEFT JOIN i ON o.k >= i.first_key", o="SELECT printf('key%013d', o_orderkey) k FROM orders", i="SELECT printf('key%013d', o_orderkey) first_key, o_orderkey // 64 block FROM orders WHERE o_orderkey % 64 = 5")
def floor_block_lookup(spark, sf_dir):
    """Every order's key, over all blocks."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    index = o.filter("o_orderkey % 64 = 5").select(F.format_string("key%013d", "o_orderkey").cast("binary").alias("first_key"), F.expr("o_orderkey div 64").alias("block"))
    return readable(tables.floor_block(index, o.select(F.format_string("key%013d", "o_orderkey").cast("binary").alias("user_key"))))


@query("SELECT table_id, n_rows FROM r WHERE table_id % 3 <> 0 UNION ALL SELECT table_id + 1000, n_rows FROM r WHERE table_id % 3 = 0 AND (table_id + 1000) % 3 <> 0", "events_log", r=RUNS)
def apply_edits(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("table_id", "n_rows")
    added = runs.filter("table_id % 3 = 0").withColumn("table_id", F.col("table_id") + 1000)
    gone = runs.unionByName(added).filter("table_id % 3 = 0").select("table_id")
    return tables.apply_edits(runs, added, gone)


@query("SELECT table_id, CAST(level AS integer) AS level, row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -table_id ELSE table_id END) select_rank, row_number() OVER (ORDER BY level DESC, table_id) scan_rank FROM r", "events_log", r=RUNS)
def precedence_order(spark, sf_dir):
    return tables.read_order(_runs(spark, sf_dir))


@query("SELECT max(table_id) + 1 next_id FROM r", "events_log", r=RUNS)
def next_table_id(spark, sf_dir):
    return tables.next_table_id(_runs(spark, sf_dir))


@query("SELECT table_id FROM r WHERE table_id % 4 = 1", "events_log", r=RUNS)
def orphan_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return tables.orphans(runs, runs.filter("table_id % 4 <> 1"))


@query("SELECT CAST(sum(CAST(v AS bigint)) AS bigint) total FROM bank_kv", "bank_kv")
def bank_total(spark, sf_dir):
    return reads.snapshot(fx.bank_kv(spark, sf_dir)).agg(F.sum(F.col("value").cast("string").cast("long")).alias("total"))


@query("SELECT CAST(sum(c) AS bigint) before, CAST(sum(c + d) AS bigint) after, CAST(sum(abs(d)) AS bigint) moved FROM x", "bank_kv",
       b="SELECT CAST(k AS bigint) a, CAST(v AS bigint) c, (CAST(k AS bigint) - 1) // 2 p FROM bank_kv", m="SELECT p, arg_min(c, a) f, min(a) payer, count(*) n FROM b GROUP BY p",
       x="SELECT c, CASE WHEN n = 2 THEN sign(f) * (abs(f) // 10) * CASE WHEN a = payer THEN -1 ELSE 1 END ELSE 0 END d FROM b JOIN m USING (p)")
def bank_transfer_conserved(spark, sf_dir):
    """Each pair of neighbouring accounts moves a tenth of the first balance in one transaction."""
    v = fx.bank_kv(spark, sf_dir)
    cents = F.col("value").cast("string").cast("long")
    number = F.col("user_key").cast("string").cast("long")
    pairs = v.select(F.expr("(cast(cast(user_key as string) as bigint) - 1) div 2").alias("pair"), "user_key", number.alias("account"), cents.alias("cents"))
    moved = pairs.groupBy("pair").agg(F.min_by("cents", "account").alias("first"), F.min("account").alias("payer"), F.count("*").alias("n"))
    share = F.when(F.col("n") == 2, F.expr("first div 10")).otherwise(F.lit(0))
    after = pairs.join(moved, "pair").select("user_key", F.lit(FAR).alias("seq"), (F.col("cents") + F.when(F.col("account") == F.col("payer"), -share).otherwise(share)).cast("string").cast("binary").alias("value"), F.lit(False).alias("deleted"))
    old = reads.snapshot(v).select("user_key", cents.alias("old"))
    new = reads.snapshot(merge.union_all(v, after)).select("user_key", cents.alias("new"))
    return old.join(new, "user_key").agg(F.sum("old").alias("before"), F.sum("new").alias("after"), F.sum(F.abs(F.col("new") - F.col("old"))).alias("moved"))


@query("SELECT DISTINCT printf('%020d', user_id) element FROM events WHERE event_type = 'signup'")
def set_elements(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'signup'")
    v = e.select(F.format_string("%020d", "user_id").cast("binary").alias("user_key"), (F.col("event_id") + 1).alias("seq"), F.lit(None).cast("binary").alias("value"), F.lit(False).alias("deleted"))
    return reads.snapshot(v).select(F.col("user_key").cast("string").alias("element"))


@query("SELECT count(*) FILTER (event_type = 'purchase') AS \"value\" FROM events")
def counter_value(spark, sf_dir):
    """The versions of a key that every purchase writes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").cast("binary").alias("user_key"))
    return reads.version_counts(e).filter(F.col("user_key") == to_binary("purchase")).agg(F.coalesce(F.sum("versions"), F.lit(0)).alias("value"))


@query(None)
def crc_of_values(spark, sf_dir):
    return fx.orders_kv(spark, sf_dir).select(F.col("user_key").cast("string").alias("k"), checksum(F.col("value")).alias("crc"))


@query("SELECT w AS \"window\", (i - 1) // 64 batch, count(*) writes, min(seq) first_seq, max(seq) last_seq FROM (SELECT seq, seq // 1000 w, row_number() OVER (PARTITION BY seq // 1000 ORDER BY seq) i FROM events_log) GROUP BY ALL", "events_log")
def group_commit_batches(spark, sf_dir):
    """Batches of at most 64 writes within windows of 1,000 ticks; the seq stands for the time of arrival."""
    return mvcc.commit_batches(fx.events_log(spark, sf_dir), F.col("seq"), 1000, 64)


@query("SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS \"rank\" FROM events_log", "events_log")
def version_ranks(spark, sf_dir):
    return readable(reads.ranked(fx.events_log(spark, sf_dir)).select("user_key", "seq", "rank"))


@query("SELECT * FROM n", "events_log", b=f"SELECT * FROM events_log WHERE seq > {HALF} // 2 AND seq <= {HALF}", n=NEWEST.format("b"))
def changes_between(spark, sf_dir):
    """The second quarter of the log."""
    v = fx.events_log(spark, sf_dir)
    half = _half(v)
    return readable(reads.changes_between(v, half // 2, half))


@query("SELECT k, seq, v, deleted FROM lineitem_log", "lineitem_log")
def ordered_dump(spark, sf_dir):
    return readable(reads.ordered_dump(fx.lineitem_log(spark, sf_dir)))


@query("SELECT k, max(seq) seq, count(*) versions FROM lineitem_log GROUP BY k", "lineitem_log")
def key_range_runs(spark, sf_dir):
    """Versions dealt into key ranges: a key's versions meet in one range."""
    dealt = tables.key_ranges(fx.lineitem_log(spark, sf_dir), 8).withColumn("part", F.spark_partition_id())
    return readable(dealt.groupBy("part", "user_key").agg(F.max("seq").alias("seq"), F.count("*").alias("versions")).drop("part"))


# Queries over a store that is written, compacted and read back


@contextmanager
def _store(spark: SparkSession, sf_dir: str, **settings) -> Iterator[Store]:
    """A store in the shared folder with the events in three bulk writes."""
    with tempfile.TemporaryDirectory() as logs:
        config = StoreConfig(f"{new_path(spark, 'store')}/runs", logs, workers=False, auto_compact=False, l0_trigger=2, **settings)
        with Store.open(spark, config) as store:
            v = fx.events_log(spark, sf_dir)
            last = v.agg(F.max("seq")).first()[0] or 0
            for i in range(3):
                part = v.filter((F.col("seq") > last * i // 3) & (F.col("seq") <= last * (i + 1) // 3))
                store.write_df(part.select("user_key", "value", "deleted", F.col("seq").alias("ord")))
            yield store


LIVE = "SELECT k, v FROM n WHERE NOT deleted"


@query(LIVE, "events_log", n=NEWEST.format("events_log"))
def store_scan(spark, sf_dir):
    """All live keys after a compaction."""
    with _store(spark, sf_dir) as s:
        s.compact()
        return readable(s.scan(b""))


@query(f"SELECT k, v FROM n WHERE k >= '{LOW}' AND k < '{HIGH}' AND NOT deleted", "events_log", n=NEWEST.format("events_log"))
def store_range_read(spark, sf_dir):
    """A range of runs cut to a few kilobytes; the manifest leaves out most of them."""
    with _store(spark, sf_dir, run_bytes=1 << 12, l1_bytes=1 << 30) as s:
        s.compact()
        return readable(s.scan(LOW.encode(), HIGH.encode()))


@query(LIVE, "events_log", b="SELECT * FROM events_log WHERE seq <= (SELECT max(seq) * 2 // 3 FROM events_log)", n=NEWEST.format("b"))
def store_past_snapshot(spark, sf_dir):
    """The state before the last write, which compaction keeps for its reader."""
    with _store(spark, sf_dir, history_seqs=1) as s:
        s.compact()
        return readable(s.scan(b"", None, s.applied - 1))


@query("SELECT a.k, n.v, n.k IS NOT NULL found FROM (SELECT printf('user%06d', c_custkey) k FROM customer) a LEFT JOIN (SELECT * FROM n WHERE NOT deleted) n USING (k)", "events_log", n=NEWEST.format("events_log"))
def store_multi_get(spark, sf_dir):
    """Every customer's key."""
    with _store(spark, sf_dir) as s:
        return readable(s.multi_get(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("user%06d", "c_custkey").alias("user_key"))))


@query("SELECT k, v FROM (SELECT k, v FROM n WHERE NOT deleted AND k >= 'user000050' UNION ALL SELECT printf('user%06d', i) k, 'logged' v FROM range(50) t(i))", "events_log", n=NEWEST.format("events_log"))
def store_recovered(spark, sf_dir):
    """Runs and a log, read by a store that was opened again."""
    with _store(spark, sf_dir) as s:
        for i in range(50):
            s.put(b"user%06d" % i, b"logged")
        s.close()
        with Store.open(spark, s.config) as again:
            return readable(again.scan(b""))


@query("SELECT k, v, deleted FROM n WHERE NOT deleted", "events_log", n=NEWEST.format("events_log"))
def store_full_read(spark, sf_dir):
    """Every row of the compacted runs: tombstones are gone at the bottom."""
    with _store(spark, sf_dir) as s:
        s.compact()
        return readable(s.read_runs(list(s.manifest.version.runs.values())).select("user_key", "value", "deleted"))


@query("SELECT count(*) n_rows, min(k) head_key, max(k) tail_key FROM n WHERE NOT deleted", "events_log", n=NEWEST.format("events_log"))
def store_manifest(spark, sf_dir):
    """What the manifest says about the compacted runs, read without opening the store."""
    with _store(spark, sf_dir) as s:
        s.compact()
        runs = runs_df(spark, describe(s.config.log_dir)[1])
        return _text(runs.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.min("head_key").alias("head_key"), F.max("tail_key").alias("tail_key")), "head_key", "tail_key")
