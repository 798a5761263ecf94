"""Point, batch, range and ordered reads.

Bounds on keys are put on point rows before the log is resolved, and never on
tombstones: one that starts below a lower bound still covers keys above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versionlog.functions.keys import Order, Prefix, sort_key
from versionlog.model import RANGE_DELETE, NotFound
from versionlog.operators.resolve import resolve
from versionlog.sources.scratch import stored


def _key(key: bytes | str) -> Column:
    return F.lit(key.encode() if isinstance(key, str) else key)


def bounded(
    log: DataFrame, lower: bytes | str | None = None, upper: bytes | str | None = None, cfs: Sequence[int] | None = None, order: Order | None = None, after: bool = False, through: bool = False
) -> DataFrame:
    """A log whose point rows lie in [lower, upper) and in the given column families.

    ``after`` leaves out the lower bound itself, ``through`` takes the upper one in; with an ``order`` bounds
    and keys compare by it.
    """
    at, inside = sort_key(order), F.lit(True)
    if lower is not None:
        low = sort_key(order, _key(lower))
        inside &= at > low if after else at >= low
    if upper is not None:
        high = sort_key(order, _key(upper))
        inside &= at <= high if through else at < high
    log = log if cfs is None else log.where(F.col("cf_id").isin(*cfs))
    return log.where(inside | (F.col("op") == RANGE_DELETE))


def scan(
    log: DataFrame,
    lower: bytes | str | None = None,
    upper: bytes | str | None = None,
    reverse: bool = False,
    limit: int | None = None,
    cfs: Sequence[int] | None = None,
    order: Order | None = None,
    after: bool = False,
    through: bool = False,
    **how,
) -> DataFrame:
    """Keys in order; with a limit, the first ones (a top-k, no full sort).  Keys that an ``order`` holds equal go by their bytes."""
    state = resolve(bounded(log, lower, upper, cfs, order, after, through), **how)
    by = [F.col("cf_id"), *([sort_key(order)] if order else []), F.col("key")]
    ordered = state.orderBy(*[c.desc() if reverse else c.asc() for c in by])
    return ordered if limit is None else ordered.limit(limit)


def get(log: DataFrame, key: bytes | str, cf_id: int = 0, **how) -> DataFrame:
    """One row, or none."""
    return resolve(log.where((F.col("cf_id") == cf_id) & ((F.col("key") == _key(key)) | (F.col("op") == RANGE_DELETE))), **how)


def get_value(log: DataFrame, key: bytes | str, cf_id: int = 0, **how) -> bytes:
    rows = get(log, key, cf_id, **how).select("value").take(1)
    if not rows:
        raise NotFound(repr(key))
    return rows[0][0] if rows[0][0] is None else bytes(rows[0][0])


def of_keys(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The point rows of the wanted keys (cf_id, key), and all tombstones."""
    rows = log.where(F.col("op") != RANGE_DELETE).join(wanted.select("cf_id", "key").distinct(), ["cf_id", "key"], "left_semi")
    return rows.unionByName(log.where(F.col("op") == RANGE_DELETE))


def multi_get(log: DataFrame, probes: DataFrame, **how) -> DataFrame:
    """Probes (pos, key; cf_id if the log has several) -> pos, key, found, value: in order, repeated ones repeated, misses kept."""
    if "cf_id" not in probes.columns:
        probes = probes.withColumn("cf_id", F.lit(0))
    state = resolve(of_keys(log, probes), **how).select("cf_id", "key", "value", F.lit(True).alias("found"))
    return probes.join(state, ["cf_id", "key"], "left").select("pos", "cf_id", "key", F.coalesce("found", F.lit(False)).alias("found"), "value").orderBy("pos")


def key_may_exist(log: DataFrame, probes: DataFrame, **how) -> DataFrame:
    """Exact: the probes (cf_id, key) that exist.  Only their rows are resolved."""
    return probes.join(resolve(of_keys(log, probes), **how).select("cf_id", "key"), ["cf_id", "key"], "left_semi")


def prefix_scan(log: DataFrame, target: bytes | str, prefix: Prefix, total_order: bool = False, **how) -> DataFrame:
    """Keys from the target on that are in the domain and share the target's prefix; with ``total_order`` all keys from it on."""
    if total_order:
        return scan(log, lower=target, **how)
    t = _key(target)
    same = (F.col("key") >= t) & prefix.domain(F.col("key")) & (prefix.of(F.col("key")) == prefix.of(t))
    return resolve(log.where(same | (F.col("op") == RANGE_DELETE)), **how).orderBy("cf_id", "key")


def seek(log: DataFrame, target: bytes | str, **how) -> DataFrame:
    """The first key at or after the target."""
    return scan(log, lower=target, limit=1, **how)


def seek_for_prev(log: DataFrame, target: bytes | str, **how) -> DataFrame:
    """The last key at or before the target."""
    return scan(log, upper=target, through=True, reverse=True, limit=1, **how)


def page_after(log: DataFrame, cursor: bytes | str, n: int, **how) -> DataFrame:
    """The next n keys after a cursor."""
    return scan(log, lower=cursor, after=True, limit=n, **how)


def neighbours(state: DataFrame) -> DataFrame:
    """Every key with the one before and the one after it.

    Keys are sorted into ranges of about equal size; neighbours are looked up within a range and only the ranges' ends,
    a row for each, across them.
    """
    ranged = stored(state.repartitionByRange("cf_id", "key").withColumn("__part", F.spark_partition_id()), "neighbours")
    by = Window.partitionBy("cf_id", "__part").orderBy("key")
    ends = ranged.groupBy("cf_id", "__part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    across = Window.partitionBy("cf_id").orderBy("__part")
    ends = ends.select("cf_id", "__part", F.lag("hi").over(across).alias("__before"), F.lead("lo").over(across).alias("__after"))
    joined = ranged.join(ends, ["cf_id", "__part"])
    prev, following = F.coalesce(F.lag("key").over(by), "__before"), F.coalesce(F.lead("key").over(by), "__after")
    return joined.withColumn("prev_key", prev).withColumn("next_key", following).drop("__part", "__before", "__after")


def placed(rows: DataFrame, order: Sequence[Column], by: str = "place") -> DataFrame:
    """Rows with their place (from 1) in a caller's order.

    The rows are sorted once into ranges; of each range only its size meets in one place.
    """
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "placed")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(sizes, "__part").withColumn(by, (F.col("__before") + nth).cast("long")).drop("__part", "__before")


def merged_runs(*runs: DataFrame) -> DataFrame:
    """One log of several sorted runs."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out
