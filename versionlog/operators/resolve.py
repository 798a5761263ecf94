"""The state of a log: the latest visible version of each key, operands folded.

For each key, B is the newest seq of a base operation and T the newest seq of a
range deletion over it; all above both counts.  B is a partial aggregate and is
joined back, so a key with a third of all rows neither meets in one task nor
needs a window, and adaptive execution can split its side of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.model import BASES, MERGE, VALUES, points, tombstones, visible
from versionlog.operators import rangedel
from versionlog.operators.merge import MergeOperator, folded

KEYS = ["cf_id", "key"]


def floors(rows: DataFrame, tombs: DataFrame | None = None) -> DataFrame:
    """cf_id, key, base_seq, cover_seq of every key of the point rows; -1 where there is none."""
    based = rows.groupBy(*KEYS).agg(F.coalesce(F.max(F.when(F.col("op").isin(*BASES), F.col("seq"))), F.lit(-1)).alias("base_seq"))
    if tombs is None:
        return based.withColumn("cover_seq", F.lit(-1).cast("long"))
    covered = rangedel.cover(based, tombs)
    return based.join(covered, KEYS, "left").withColumn("cover_seq", F.coalesce("cover_seq", F.lit(-1).cast("long")))


def counting(log: DataFrame, snapshot: int | None = None, ranges: bool = True) -> DataFrame:
    """The rows that make each key's value: its base, if one stands, and the operands above it.

    ``ranges=False`` says that the log has no range deletions, and saves looking for them.
    """
    seen = visible(log, snapshot)
    rows = points(seen)
    floor = floors(rows, tombstones(seen) if ranges else None)
    joined = rows.select(*KEYS, "seq", "op", "value").join(floor, KEYS)
    # a row is covered if its seq is below the tombstone's, not at the same one
    base = F.col("op").isin(*VALUES) & (F.col("seq") == F.col("base_seq")) & (F.col("base_seq") >= F.col("cover_seq"))
    operand = (F.col("op") == MERGE) & (F.col("seq") > F.col("base_seq")) & (F.col("seq") >= F.col("cover_seq"))
    return joined.where(base | operand).select(*KEYS, "seq", "op", "value")


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """State of a log of puts and deletes alone: one aggregate, one shuffle."""
    newest = visible(log, snapshot).groupBy(*KEYS).agg(F.max(F.struct("seq", "op", "value")).alias("v"))
    return newest.where(F.col("v.op").isin(*VALUES)).select(*KEYS, "v.value", "v.seq")


def resolve(log: DataFrame, snapshot: int | None = None, merge: str | MergeOperator | None = None, on_error: str = "raise", ranges: bool = True) -> DataFrame:
    """STATE: cf_id, key, value, seq of every key that exists at the snapshot.

    Keys with operands go through the merge operator; the others keep their base's bytes.
    An empty value exists, a key without a row does not.
    """
    rows = counting(log, snapshot, ranges)
    if merge is not None:
        return folded(rows, merge, on_error)
    flagged = rows.groupBy(*KEYS).agg(F.max(F.struct("seq", "op", "value")).alias("v"), F.max(F.col("op") == MERGE).alias("operands"))
    message = F.lit("NoMergeOperator: operands without a merge operator")
    value = F.when(F.col("operands"), F.raise_error(message).cast("binary")).otherwise(F.col("v.value"))
    return flagged.select(*KEYS, value.alias("value"), F.col("v.seq").alias("seq"))


def history(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """All versions of every key, newest first within a key."""
    return points(visible(log, snapshot)).orderBy("cf_id", "key", F.desc("seq"), F.desc("op"))
