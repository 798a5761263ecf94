"""Schemas, operation codes and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operation codes.
DELETE, PUT, MERGE, SINGLE_DELETE, RANGE_DELETE, WIDE_ENTITY = 0, 1, 2, 7, 15, 22
#: Operations that end the search for older versions of a key.
BASES = (DELETE, PUT, SINGLE_DELETE, WIDE_ENTITY)
#: Of these, the ones that leave a value.
VALUES = (PUT, WIDE_ENTITY)
MAX_SEQ = (1 << 56) - 1
DEFAULT_CF = 0

OPLOG = T.StructType(
    [
        T.StructField("cf_id", T.IntegerType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.ByteType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("end_key", T.BinaryType()),
        T.StructField("batch_seq", T.LongType()),
        T.StructField("batch_pos", T.IntegerType()),
        T.StructField("ts", T.DecimalType(20, 0)),
    ]
)
STATE = T.StructType([OPLOG["cf_id"], OPLOG["key"], OPLOG["value"], OPLOG["seq"]])
FILES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("version_id", "file_number")]
    + [T.StructField(n, T.IntegerType()) for n in ("level", "cf_id")]
    + [T.StructField("size", T.LongType())]
    + [T.StructField(n, T.BinaryType()) for n in ("smallest", "largest")]
    + [T.StructField(n, T.LongType()) for n in ("smallest_seq", "largest_seq", "num_entries", "num_deletes", "num_merges", "num_range_dels", "created_at")]
)


class StoreError(Exception):
    """Base of the library's errors."""


class NotFound(StoreError):
    """A key, column family or version does not exist."""


class ReadOnly(StoreError):
    """A write through a reader."""


class MergeFailed(StoreError):
    """A merge operator rejected a base or an operand."""


class NoMergeOperator(StoreError):
    """Operands without an operator."""


class Conflict(StoreError):
    """A transaction lost against a newer write."""


class InvalidInput(StoreError):
    """Arguments that break a documented rule."""


def oplog(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as a log: given expressions, defaults for the rest, types as in OPLOG."""
    default = {"cf_id": F.lit(DEFAULT_CF), "batch_seq": columns["seq"], "batch_pos": F.lit(0)}
    return df.select(*[columns.get(f.name, default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in OPLOG])


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OPLOG)


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Rows of a snapshot; None is the latest."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def points(log: DataFrame) -> DataFrame:
    return log.where(F.col("op") != RANGE_DELETE)


def tombstones(log: DataFrame) -> DataFrame:
    """cf_id, start_key, end_key, seq of range deletions that cover anything."""
    found = log.where((F.col("op") == RANGE_DELETE) & (F.col("key") < F.col("end_key")))
    return found.select("cf_id", F.col("key").alias("start_key"), "end_key", "seq")
