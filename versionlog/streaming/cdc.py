"""The log as a feed of changes, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.model import OPLOG, STATE, points, tombstones
from versionlog.operators import rangedel, scan
from versionlog.operators.merge import MergeOperator
from versionlog.operators.resolve import resolve
from versionlog.sources.scratch import remove, stored


def updates_since(log: DataFrame, seq: int, include_straddling: bool = False) -> DataFrame:
    """Batches that start at seq or later, in order; optionally also the one that seq lies within."""
    late = F.col("batch_seq") >= seq
    if include_straddling:
        around = log.where((F.col("batch_seq") < seq) & (F.col("seq") >= seq)).select("batch_seq").distinct()
        rows = log.where(late).unionByName(log.join(around, "batch_seq", "left_semi").select(log.columns))
    else:
        rows = log.where(late)
    return rows.orderBy("batch_seq", "batch_pos")


def latest_seq(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("latest_seq"))


def read_changes(spark: SparkSession, path: str, bytes_a_batch: int = 1 << 30) -> DataFrame:
    """A stream of the log's new files."""
    return spark.readStream.schema(OPLOG).option("maxBytesPerTrigger", str(bytes_a_batch)).parquet(path)


def materialise(changes: DataFrame, state_path: str, checkpoint: str, merge: str | MergeOperator | None = None):
    """Keep a resolved state fresh: of each micro-batch only the keys that it touches are resolved again.

    Under ``state_path``, ``log/<batch>`` holds a batch's rows and ``state/<batch>`` the state after it; a batch that
    runs again after a failure writes the same folders.  Touched are the keys of its point rows, and of the state's
    keys those under its range deletions.  Rows are told apart by seq, so late and repeated ones do no harm.
    """
    spark = changes.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        path = lambda kind, n: f"{state_path}/{kind}/{n:012d}"
        batch.write.mode("overwrite").parquet(path("log", number))
        fresh = spark.read.schema(OPLOG).parquet(path("log", number))
        before = spark.createDataFrame([], STATE) if number == 0 else spark.read.schema(STATE).parquet(path("state", number - 1))
        touched = points(fresh).select("cf_id", "key").distinct()
        tombs = tombstones(fresh)
        if not tombs.isEmpty():
            touched = touched.unionByName(rangedel.cover(before, tombs).select("cf_id", "key")).distinct()
        touched = stored(touched, "touched")
        log = spark.read.schema(OPLOG).parquet(*[path("log", n) for n in range(number + 1)])
        rows = scan.of_keys(log, touched).dropDuplicates(["cf_id", "key", "seq", "op"])
        now = before.join(touched, ["cf_id", "key"], "left_anti").select(STATE.names).unionByName(resolve(rows, merge=merge).select(STATE.names))
        now.write.mode("overwrite").parquet(path("state", number))
        if number > 1:
            remove(spark, path("state", number - 2))

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(trace: DataFrame) -> DataFrame:
    """A trace (ts_ns, type, cf_id, key, seq, data) as a log: writes become rows, in order of their time."""
    from versionlog.model import DELETE, MERGE, PUT, oplog

    ops = {"put": PUT, "delete": DELETE, "merge": MERGE}
    op = F.lit(None).cast("int")
    for name, code in ops.items():
        op = F.when(F.col("type") == name, code).otherwise(op)
    return oplog(trace.where(F.col("type").isin(*ops)), cf_id=F.col("cf_id"), key=F.col("key"), seq=F.col("seq"), op=op, value=F.col("data"))


def replay_counts(trace: DataFrame) -> DataFrame:
    """What a replay does with each kind of record: applied, read or skipped."""
    what = F.when(F.col("type").isin("put", "delete", "merge"), "applied").when(F.col("type").isin("get", "iter_seek"), "read").otherwise("skipped")
    return trace.groupBy("type", what.alias("outcome")).agg(F.count("*").alias("n"))
