"""Compaction filters: what becomes of a key's value when the log is rewritten.

A filter maps key and value to a decision, keep, remove or change, and a new value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.functions.codecs import created_at_of
from versionlog.model import MERGE
from versionlog.operators.timetravel import expired

KEEP, REMOVE, CHANGE = "keep", "remove", "change"


@dataclass(frozen=True)
class CompactionFilter:
    name: str
    decide: Callable[[Column, Column], Column]
    change: Callable[[Column, Column], Column] = lambda key, value: value
    keep_operand: Callable[[Column, Column], Column] = lambda key, value: F.lit(True)


@dataclass(frozen=True)
class FilterContext:
    """What a factory is told of a rewrite."""

    is_full: bool = True
    is_manual: bool = True
    cf_id: int = 0


def _remove(name: str, gone: Callable[[Column, Column], Column]) -> CompactionFilter:
    return CompactionFilter(name, lambda k, v: F.when(gone(k, v), REMOVE).otherwise(KEEP))


def remove_by_prefix(prefix: bytes | str) -> CompactionFilter:
    p = F.lit(prefix.encode() if isinstance(prefix, str) else prefix)
    return _remove("remove_by_prefix", lambda k, v: F.startswith(k, p))


def remove_by_range(start: bytes | None, end: bytes | None) -> CompactionFilter:
    """[start, end); None is unbounded."""

    def inside(k: Column, v: Column) -> Column:
        found = F.lit(True)
        if start is not None:
            found &= k >= F.lit(start)
        if end is not None:
            found &= k < F.lit(end)
        return found

    return _remove("remove_by_range", inside)


def remove_expired(ttl: int, now: int) -> CompactionFilter:
    """Values with a creation second behind them that have expired."""
    return _remove("remove_expired", lambda k, v: (F.length(v) >= 8) & expired(created_at_of(v), ttl, now))


def change_value(name: str, when: Callable[[Column, Column], Column], to: Callable[[Column, Column], Column]) -> CompactionFilter:
    return CompactionFilter(name, lambda k, v: F.when(when(k, v), CHANGE).otherwise(KEEP), to)


def apply(state: DataFrame, f: CompactionFilter) -> DataFrame:
    """A resolved state after the filter."""
    decision = f.decide(F.col("key"), F.col("value"))
    return state.withColumn("__d", decision).where(F.col("__d") != REMOVE).withColumn("value", F.when(F.col("__d") == CHANGE, f.change(F.col("key"), F.col("value"))).otherwise(F.col("value"))).drop("__d")


def filter_operands(log: DataFrame, f: CompactionFilter) -> DataFrame:
    """A log without the operands that the filter rejects."""
    return log.where((F.col("op") != MERGE) | f.keep_operand(F.col("key"), F.col("value")))
