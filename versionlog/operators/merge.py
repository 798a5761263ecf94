"""Merge operators: ordered folds of operands over a base.

An operator turns the rows of a key that count (at most one base, op PUT, and
operands above it) into a value.  Those that commute are plain aggregates, which
Spark combines before the shuffle; those that do not sort by seq.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.functions.codecs import decode_u64le, encode_u64le
from versionlog.model import MERGE, VALUES, MergeFailed, NoMergeOperator

KEYS = ["cf_id", "key"]


@dataclass(frozen=True)
class MergeOperator:
    """``fold`` takes rows (cf_id, key, seq, op, value) and the columns to group by to these columns, value, seq, failed and
    what further aggregates are asked for; ``associative``: operands may be combined among themselves.

    A row with a deletion stands for no base.
    """

    name: str
    fold: Callable[..., DataFrame]
    associative: bool = True


def _aggregate(value: Column, failed: Column | None = None):
    """A key without operands keeps its base, whatever its bytes are."""
    operands, base = F.max(F.col("op") == MERGE), F.max(F.when(F.col("op").isin(*VALUES), F.col("value")))
    failed = F.lit(False) if failed is None else operands & failed

    def fold(rows: DataFrame, by: list[str] = KEYS, more: dict[str, Column] | None = None) -> DataFrame:
        aggregates = [c.alias(n) for n, c in (more or {}).items()]
        return rows.groupBy(*by).agg(F.when(operands, value).otherwise(base).alias("value"), F.max("seq").alias("seq"), failed.alias("failed"), *aggregates)

    return fold


def uint64_add() -> MergeOperator:
    """Little-endian sums modulo 2^64; a base or operand of another length than 8 fails; no base is 0."""
    total = F.sum(decode_u64le(F.col("value"))) % F.lit(str(1 << 64)).cast("decimal(20,0)")
    bad = F.max(F.col("op").isin(*VALUES, MERGE) & (F.coalesce(F.length("value"), F.lit(0)) != 8))
    return MergeOperator("uint64_add", _aggregate(F.when(~bad, encode_u64le(total.cast("decimal(20,0)"))), bad))


def _ordered(element: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("op").isin(*VALUES, MERGE), F.struct("seq", element.alias("v")))))


def string_append(delimiter: bytes | str = ",") -> MergeOperator:
    """Non-empty parts in order of seq, the delimiter between them; nothing but empty parts give an empty value."""
    text = delimiter if isinstance(delimiter, str) else delimiter.decode("latin-1")
    d = F.encode(F.lit(text), "ISO-8859-1" if isinstance(delimiter, bytes) else "UTF-8")
    parts = F.filter(F.transform(_ordered(F.col("value")), lambda s: s["v"]), lambda v: F.length(v) > 0)
    empty = F.lit(b"")
    joined = F.aggregate(parts, empty, lambda done, v: F.when(F.length(done) == 0, v).otherwise(F.concat(done, d, v)))
    return MergeOperator("string_append", _aggregate(joined))


def max_value() -> MergeOperator:
    """The largest bytes."""
    return MergeOperator("max", _aggregate(F.max("value")))


def signed_add() -> MergeOperator:
    """Signed 64-bit little-endian sums."""
    raw = decode_u64le(F.col("value"))
    half, full = F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    signed = F.when(raw >= half, raw - full).otherwise(raw)
    total = F.sum(signed.cast("decimal(20,0)"))
    return MergeOperator("signed_add", _aggregate(encode_u64le(F.when(total < 0, total + full).otherwise(total).cast("decimal(20,0)"))))


def associative(name: str, combine: Callable[[Column, Column], Column]) -> MergeOperator:
    """A left fold of a binary column function, oldest first; the base comes first."""
    parts = F.transform(_ordered(F.col("value")), lambda s: s["v"])
    folded = F.reduce(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), combine)
    return MergeOperator(name, _aggregate(folded))


def custom(name: str, full_merge: Callable[[bytes, bytes | None, list[bytes]], bytes | None], is_associative: bool = False) -> MergeOperator:
    """Any Python function of (key, base, operands oldest first); None is a failure.

    A key's operands meet in one task, as the function asks for them all.
    """

    def fold(rows: DataFrame, by: list[str] = KEYS, more: dict[str, Column] | None = None) -> DataFrame:
        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("seq")
            base = group.loc[group["op"] != MERGE, "value"]
            operands = group.loc[group["op"] == MERGE, "value"].tolist()
            base = base.iloc[-1] if len(base) else None
            value = full_merge(group["key"].iloc[0], base, operands) if operands else base
            made = {c: group[c].iloc[:1].to_numpy() for c in by}
            return pd.DataFrame({**made, "value": [value], "seq": [group["seq"].max()], "failed": [bool(operands) and value is None]})

        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
        done = rows.select(*by, "seq", "op", "value").groupBy(*by).applyInPandas(one, f"{kinds}, value binary, seq long, failed boolean")
        if not more:
            return done
        return done.join(rows.groupBy(*by).agg(*[c.alias(n) for n, c in more.items()]), by)

    return MergeOperator(name, fold, is_associative)


REGISTRY: dict[str, Callable[..., MergeOperator]] = {"uint64_add": uint64_add, "string_append": string_append, "max": max_value, "signed_add": signed_add}


def operator(merge: str | MergeOperator | None) -> MergeOperator | None:
    return REGISTRY[merge]() if isinstance(merge, str) else merge


def folded(rows: DataFrame, merge: str | MergeOperator | None, on_error: str = "raise", by: list[str] = KEYS, more: dict[str, Column] | None = None) -> DataFrame:
    """cf_id, key, value, seq of rows that have operands.  Failures raise, or give null with ``on_error="null"``.

    ``by`` groups by other columns, ``more`` adds aggregates.
    """
    op = operator(merge)
    if op is None:
        message = F.lit(f"{NoMergeOperator.__name__}: operands without a merge operator")
        return rows.groupBy(*KEYS).agg(F.max("value").alias("value"), F.max("seq").alias("seq")).withColumn("value", F.coalesce(F.raise_error(message).cast("binary"), F.col("value")))
    done = op.fold(rows, by, more)
    if on_error == "raise":
        message = F.concat(F.lit(f"{MergeFailed.__name__}: {op.name} failed for key "), F.hex("key"))
        done = done.withColumn("value", F.when(F.col("failed"), F.raise_error(message).cast("binary")).otherwise(F.col("value")))
    else:
        done = done.withColumn("value", F.when(~F.col("failed"), F.col("value")))
    return done.select(*by, "value", "seq", *(more or {}))
