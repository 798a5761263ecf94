"""User timestamps and time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.functions.codecs import created_at_of, strip_expiry_base
from versionlog.model import DELETE, SINGLE_DELETE, VALUES

KEYS = ["cf_id", "key"]


def as_of(log: DataFrame, ts) -> DataFrame:
    """The newest version of each key at or before ts, unless a deletion is newer: cf_id, key, value, ts.

    A deletion at a timestamp hides all cells up to it.
    """
    newest = log.where(F.col("ts") <= F.lit(ts)).groupBy(*KEYS).agg(F.max(F.struct("ts", "seq", "op", "value")).alias("v"))
    return newest.where(F.col("v.op").isin(*VALUES)).select(*KEYS, "v.value", "v.ts")


def versions(log: DataFrame, upto, since=None) -> DataFrame:
    """All cells in [since, upto] that no deletion at or before ``upto`` hides, newest first within a key.

    Of several writes of one cell the last counts.
    """
    seen = log.where(F.col("ts") <= F.lit(upto))
    hidden = seen.where(F.col("op").isin(DELETE, SINGLE_DELETE)).groupBy(*KEYS).agg(F.max("ts").alias("gone"))
    cells = seen.where(F.col("op").isin(*VALUES)).groupBy(*KEYS, "ts").agg(F.max(F.struct("seq", "value")).alias("v"))
    cells = cells.join(hidden, KEYS, "left").where(F.col("gone").isNull() | (F.col("ts") > F.col("gone")))
    if since is not None:
        cells = cells.where(F.col("ts") >= F.lit(since))
    return cells.select(*KEYS, "ts", "v.value").orderBy(*KEYS, F.desc("ts"))


def expired(created_at: Column, ttl: int, now: int) -> Column:
    """Strictly older than ttl seconds; ttl of 0 or less never ends."""
    return F.lit(False) if ttl <= 0 else F.lit(now) > created_at + ttl


def alive(state: DataFrame, ttl: int, now: int) -> DataFrame:
    """Rows (with created_at) that are not expired."""
    return state.where(~expired(F.col("created_at"), ttl, now))


def alive_values(state: DataFrame, ttl: int, now: int) -> DataFrame:
    """Raw values with a creation second behind them: expired rows go, the second is cut off; values too short for one stay."""
    stamped = F.length("value") >= 8
    gone = stamped & expired(created_at_of(F.col("value")), ttl, now)
    return state.where(~gone).withColumn("value", strip_expiry_base(F.col("value")))
