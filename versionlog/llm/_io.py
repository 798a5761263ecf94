"""Shared folders and small helpers that several operators use."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.sources.scratch import Scratch, shared_dir, stored  # noqa: F401  operators take them from here

#: What operators need of a session.  Python workers get batches of so many rows and bytes at most, as texts may be
#: long; shuffle files of a step go when it has ended, as its result is stored.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker keeps between tasks; one thing at a time.
KEPT: dict[tuple, object] = {}


def forget() -> None:
    """Called at the start of tasks that need nothing kept: another operator's tables give way."""
    if KEPT:
        KEPT.clear()
        trim()


def trim() -> None:
    """Give a worker's free memory back: it may wait idle beside those of the next step."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Prepare the session, and send this package to the workers, once for each context; they may run elsewhere."""
    context = spark.sparkContext
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).parent.parent
        path = f"{tempfile.mkdtemp(prefix='versionlog-')}/{package.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, str(f.relative_to(package.parent)))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text as string; null counts as empty."""
    ship(df.sparkSession)
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns.  An input column of the same name (in any case) gives way."""
    names = {c.lower() for c in columns}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in names]
    return df.select(*kept, *(value.alias(name) for name, value in columns.items()))
