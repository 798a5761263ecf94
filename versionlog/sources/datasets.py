"""Logs and other inputs made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.functions.codecs import encode_u64le
from versionlog.model import DELETE, MERGE, PUT, RANGE_DELETE, oplog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(prefix: str, number: Column, width: int = 6) -> Column:
    """A key whose order is that of the number."""
    return F.encode(F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0")), "UTF-8")


def user_key(number: Column) -> Column:
    return key_of("u", number)


def event_op(ranges: bool) -> Column:
    """Clicks put, errors delete, other events merge; with ranges every seventh signup deletes three users."""
    kind = F.col("event_type")
    op = F.when(kind == "click", PUT).when(kind == "error", DELETE).otherwise(MERGE)
    return F.when((kind == "signup") & (F.col("event_id") % 7 == 0), RANGE_DELETE).otherwise(op) if ranges else op


def events_log(spark: SparkSession, sf_dir: str, ranges: bool = False) -> DataFrame:
    """Counters by user: value is the event's value in whole numbers, little-endian."""
    e = table(spark, sf_dir, "events")
    op = event_op(ranges)
    value = F.when(~op.isin(DELETE, RANGE_DELETE), encode_u64le(F.floor(F.abs(F.col("value")))))
    end = F.when(op == RANGE_DELETE, user_key(F.col("user_id") + 3))
    seq = F.col("event_id") + 1
    return oplog(e, key=user_key(F.col("user_id")), seq=seq, op=op, value=value, end_key=end, batch_seq=seq - F.col("event_id") % 10, batch_pos=F.col("event_id") % 10, ts=F.col("event_id") * 10)


def texts_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``events_log``, with the event type as value."""
    e = table(spark, sf_dir, "events")
    op = event_op(False)
    return oplog(e, key=user_key(F.col("user_id")), seq=F.col("event_id") + 1, op=op, value=F.encode(F.when(op != DELETE, F.concat_ws("-", "event_type", "event_id")), "UTF-8"))


def orders_log(spark: SparkSession, sf_dir: str, by_nation: bool = False) -> DataFrame:
    """Orders by customer: each order puts its priority, every tenth deletes; optionally a column family for each customer's remainder by 5."""
    o = table(spark, sf_dir, "orders")
    op = F.when(F.col("o_orderkey") % 10 == 0, DELETE).otherwise(PUT)
    cf = (F.col("o_custkey") % 5) if by_nation else F.lit(0)
    value = F.encode(F.when(op == PUT, F.concat_ws("|", "o_orderpriority", "o_orderkey")), "UTF-8")
    return oplog(o, cf_id=cf, key=key_of("c", F.col("o_custkey"), 8), seq=F.col("o_orderkey") + 1, op=op, value=value, ts=F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")))


def sources_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and id, the language as value."""
    d = table(spark, sf_dir, "documents")
    key = F.encode(F.concat_ws(":", "source", F.lpad(F.col("doc_id").cast("string"), 8, "0")), "UTF-8")
    return oplog(d, key=key, seq=F.col("doc_id") + 1, op=F.lit(PUT), value=F.encode("lang", "UTF-8"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as wide entities."""
    c = table(spark, sf_dir, "customer")
    columns = F.create_map(F.lit(b"name"), F.encode("c_name", "UTF-8"), F.lit(b"segment"), F.encode("c_mktsegment", "UTF-8"))
    return c.select(F.lit(0).alias("cf_id"), key_of("c", F.col("c_custkey"), 8).alias("key"), F.lit(0).cast("long").alias("seq"), columns.alias("columns"))


def order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders write to their customers' entities."""
    o = table(spark, sf_dir, "orders")
    columns = F.create_map(F.lit(b"last_priority"), F.encode("o_orderpriority", "UTF-8"), F.lit(b"last_status"), F.encode("o_orderstatus", "UTF-8"))
    return o.select(F.lit(0).alias("cf_id"), key_of("c", F.col("o_custkey"), 8).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), columns.alias("columns"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of files: every 250 events are one, older ones on deeper levels."""
    e = table(spark, sf_dir, "events")
    number = F.floor(F.col("event_id") / 250)
    grouped = e.groupBy(number.alias("file_number")).agg(
        F.sum(F.length("props").cast("long") * 1000).alias("size"), F.min("user_id").alias("lo"), F.max("user_id").alias("hi"), F.min(F.col("event_id") + 1).alias("smallest_seq"), F.max(F.col("event_id") + 1).alias("largest_seq"),
        F.count("*").alias("num_entries"), F.count_if(F.col("event_type") == "error").alias("num_deletes"), F.count_if(~F.col("event_type").isin("error", "click")).alias("num_merges"),
    )
    level = (F.col("file_number") % 4).cast("int")
    return grouped.select(
        F.lit(1).cast("long").alias("version_id"), "file_number", level.alias("level"), F.lit(0).alias("cf_id"), "size", user_key(F.col("lo")).alias("smallest"), user_key(F.col("hi")).alias("largest"), "smallest_seq", "largest_seq", "num_entries", "num_deletes", "num_merges",
        F.lit(0).cast("long").alias("num_range_dels"), (F.lit(1_000_000) + F.col("file_number") * 60).alias("created_at"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a trace."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "put").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "merge").when(F.col("event_type") == "view", "get").otherwise("new_iterator")
    return e.select((F.col("event_id") * 1_000_000).alias("ts_ns"), kind.alias("type"), F.lit(0).alias("cf_id"), user_key(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), encode_u64le(F.floor(F.abs(F.col("value")))).alias("data"))
