"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the session names in ``spark.checkpoint.dir``.

    Only where it names none and runs on one machine, as in local tests, a local folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='versionlog-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; with its path, for ``remove``."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut there, and lost executors lose nothing.

    It stays there as long as the folder does, as results are read from it when they are asked for.
    """
    return stored_at(df, label)[0]


def numbered(df: DataFrame, order: Sequence[str | Column], label: str, by: str = "place") -> DataFrame:
    """Rows with their place (from 0) in an order, stored once: what reads them twice sees the same ranges.

    The rows are sorted into ranges; of each range only its size meets in one place.
    """
    nth, bits = "__nth", 33  # of monotonically_increasing_id: the range above, the row's number in it below
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(nth, F.monotonically_increasing_id()), label)
    sizes = ranged.groupBy(F.shiftright(nth, bits).alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    found = ranged.withColumn("__part", F.shiftright(nth, bits)).join(F.broadcast(sizes), "__part")
    return found.withColumn(by, F.col("__before") + F.col(nth).bitwiseAND(F.lit((1 << bits) - 1))).drop("__part", "__before", nth)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of rounds that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate tables of one step: they go together once its result is stored."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        df, path = stored_at(df, label)
        self.paths.append(path)
        return df

    def clear(self) -> None:
        remove(self.spark, *self.paths)
        self.paths.clear()
