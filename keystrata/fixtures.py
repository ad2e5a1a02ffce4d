"""Versioned views of the sample tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.schema import versioned


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return versioned(o.select(
        F.format_string("key%013d", "o_orderkey").alias("k"), (F.col("o_orderkey") + 1).alias("seq"),
        F.concat("o_orderstatus", F.lit(":"), "o_orderpriority").alias("v"), F.lit(False).alias("deleted"),
    ))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return versioned(e.select(
        F.format_string("user%06d", "user_id").alias("k"), (F.col("event_id") + 1).alias("seq"),
        F.when(~gone, F.concat("event_type", F.lit("#"), F.col("event_id").cast("string"))).alias("v"), gone.alias("deleted"),
    ))


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    gone = F.col("l_returnflag") == "R"
    return versioned(li.select(
        F.format_string("%010d-%d", "l_orderkey", "l_linenumber").alias("k"), F.row_number().over(w).cast("long").alias("seq"),
        F.when(~gone, F.concat("l_linestatus", F.lit(":"), F.col("l_quantity").cast("long").cast("string"))).alias("v"), gone.alias("deleted"),
    ))


def tx_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten writes a transaction, with their place in it and the snapshot it began at."""
    e = _table(spark, sf_dir, "events")
    seq = (F.expr("event_id div 10") + 1).cast("long")
    gone = F.col("event_type") == "error"
    return e.select(
        F.format_string("user%06d", "user_id").cast("binary").alias("user_key"), seq.alias("seq"), (F.col("event_id") % 10).alias("ord"),
        F.when(~gone, F.col("event_type")).cast("binary").alias("value"), gone.alias("deleted"), F.greatest(seq - 3, F.lit(0).cast("long")).alias("snapshot_seq"),
    )


def bank_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return versioned(c.select(
        F.format_string("%020d", "c_custkey").alias("k"), (F.col("c_custkey") + 1).alias("seq"),
        F.round(F.col("c_acctbal") * 100).cast("long").cast("string").alias("v"), F.lit(False).alias("deleted"),
    ))


SQL = {
    "orders_kv": "SELECT printf('key%013d', o_orderkey) k, o_orderkey + 1 seq, o_orderstatus || ':' || o_orderpriority v, false deleted FROM orders",
    "events_log": "SELECT printf('user%06d', user_id) k, event_id + 1 seq, CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '#' || CAST(event_id AS varchar) END v, event_type = 'error' deleted FROM events",
    "lineitem_log": "SELECT printf('%010d-%d', l_orderkey, l_linenumber) k, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) seq, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus || ':' || CAST(CAST(l_quantity AS bigint) AS varchar) END v, l_returnflag = 'R' deleted FROM lineitem",
    "tx_log": "SELECT event_id // 10 + 1 seq, event_id % 10 ord, printf('user%06d', user_id) k, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END v, event_type = 'error' deleted, greatest(event_id // 10 + 1 - 3, 0) snapshot_seq FROM events",
    "bank_kv": "SELECT printf('%020d', c_custkey) k, c_custkey + 1 seq, CAST(CAST(round(c_acctbal * 100) AS bigint) AS varchar) v, false deleted FROM customer",
}
