"""Bulk loading of sorted files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versionlog.model import DELETE, MERGE, PUT, RANGE_DELETE, InvalidInput, oplog


def sorted_file(rows: DataFrame) -> DataFrame:
    """Rows of an external file (key, op, value, end_key) in ascending order of keys, ranges one after another.

    Range partitions are sorted each; nothing is sorted in one place.
    """
    return rows.repartitionByRange("key").sortWithinPartitions("key")


def write_file(rows: DataFrame, path: str) -> DataFrame:
    """Write an external file, sorted, and read it back.  A path that exists is an error; a job that fails leaves nothing listed."""
    if rows.isEmpty():
        raise InvalidInput("a file needs rows")
    if not rows.where((F.col("op") == RANGE_DELETE) & (F.col("key") >= F.col("end_key"))).isEmpty():
        raise InvalidInput("a range is empty")
    sorted_file(rows).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def order_errors(rows: DataFrame, position: str = "pos") -> DataFrame:
    """Rows that break the rules of a writer: keys strictly ascending in order of ``position``, ranges not empty, known operations."""
    before = F.lag("key").over(Window.partitionBy("file_id").orderBy(position))
    bad_order = (F.col("op") != RANGE_DELETE) & before.isNotNull() & (before >= F.col("key"))
    bad_range = (F.col("op") == RANGE_DELETE) & (F.col("key") >= F.col("end_key"))
    unknown = ~F.col("op").isin(PUT, DELETE, MERGE, RANGE_DELETE)
    reason = F.when(unknown, "operation").when(bad_range, "range").when(bad_order, "order")
    return rows.withColumn("reason", reason).where("reason is not null")


def file_info(rows: DataFrame) -> DataFrame:
    """A row for each file: smallest and largest key, entries, bytes."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    return rows.groupBy("file_id").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes"), F.count_if(F.col("op") == RANGE_DELETE).alias("n_range_dels"))


def overlapping(files: DataFrame) -> DataFrame:
    """Files of which a range (closed) meets that of a file before it in order of keys."""
    order = Window.partitionBy(F.lit(0)).orderBy("smallest", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("reach", F.max("largest").over(order)).where(F.col("reach") >= F.col("smallest")).drop("reach")


@dataclass(frozen=True)
class IngestOptions:
    behind: bool = False
    fail_if_not_bottommost: bool = False
    allow_global_seq: bool = True
    verify: bool = True


def ingest(log: DataFrame, files: list[DataFrame], next_seq: int, options: IngestOptions | None = None, cf_id: int = 0) -> DataFrame:
    """The log with external files (key, op, value, end_key) behind or above it.

    Above, a file's rows take one seq each file, in order of the arguments, from ``next_seq`` on; behind, seq
    0, so that anything in the log wins; a key that several files behind have counts in the last of them alone.
    """
    options = options or IngestOptions()
    if not files:
        raise InvalidInput("no files")
    for n, rows in enumerate(files):
        if options.verify and rows.isEmpty():
            raise InvalidInput(f"file {n} is empty")
        if options.fail_if_not_bottommost and not log.where(F.col("cf_id") == cf_id).join(rows.select("key").distinct(), "key", "left_semi").isEmpty():
            raise InvalidInput(f"file {n} does not fit below the log")
        if not options.behind and not options.allow_global_seq:
            raise InvalidInput("ingesting above a log needs seqs")
        if options.behind and files[n + 1 :]:
            later = reduce(DataFrame.unionByName, [f.where(F.col("op") != RANGE_DELETE).select("key") for f in files[n + 1 :]]).distinct()
            ranges = rows.where(F.col("op") == RANGE_DELETE)
            rows = rows.where(F.col("op") != RANGE_DELETE).join(later, "key", "left_anti").select(rows.columns).unionByName(ranges)
        seq = F.lit(0 if options.behind else next_seq + n).cast("long")
        made = oplog(rows, cf_id=F.lit(cf_id), key=F.col("key"), seq=seq, op=F.col("op"), value=F.col("value"), end_key=F.col("end_key") if "end_key" in rows.columns else F.lit(None))
        log = log.unionByName(made)
    return log
