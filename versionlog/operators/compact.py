"""Rewriting a log to a smaller one with the same visible states.

Live snapshots cut seqs into strata; a row's stratum is the first snapshot at or
above its seq, or the newest one.  Within (column family, key, stratum) the rows
fold into at most a base and a value of operands, so every live snapshot and the
latest state read the same.  Tombstone rows are kept, unless a full rewrite
without live snapshots shows that nothing older survives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versionlog.model import BASES, DEFAULT_CF, DELETE, MERGE, OPLOG, PUT, RANGE_DELETE, VALUES, points, tombstones
from versionlog.operators import rangedel
from versionlog.operators.filters import CHANGE, REMOVE, CompactionFilter, FilterContext, filter_operands
from versionlog.operators.merge import MergeOperator, folded, operator

KEYS = ["cf_id", "key"]
# Levels and the sizes and counts that start a rewrite.
LEVELS = 7
L0_TRIGGER, BASE_BYTES, LEVEL_FACTOR = 4, 256 << 20, 10
SIZE_RATIO, MIN_MERGE_WIDTH, MAX_MERGE_WIDTH, MAX_SIZE_AMP = 1, 2, 1 << 31, 200
FIFO_BYTES, INTRA_L0_FILES = 1 << 30, 10
SLOWDOWN_FILES, STOP_FILES = 20, 36


def stratum(seq: Column, snapshots: Sequence[int]) -> Column:
    """Index of the first snapshot at or above seq; len(snapshots) is the newest stratum."""
    out = F.lit(len(snapshots))
    for k, s in reversed(list(enumerate(sorted(snapshots)))):
        out = F.when(seq <= s, k).otherwise(out)
    return out


def _row(cf: str, key: str, seq: Column, op: Column, value: Column) -> list[Column]:
    made = {"cf_id": F.col(cf), "key": F.col(key), "seq": seq, "op": op, "value": value, "batch_seq": seq, "batch_pos": F.lit(0)}
    return [made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OPLOG]


def compact(log: DataFrame, snapshots: Sequence[int] = (), merge: str | MergeOperator | None = None, filter_: CompactionFilter | None = None, lower: bytes | None = None, upper: bytes | None = None, full: bool = False, ranges_too: bool | None = None) -> DataFrame:
    """The rewritten log.  With bounds only keys in [lower, upper) are rewritten.

    ``full`` says that no other file holds older rows of these keys: deletions in the oldest stratum go.  Range
    deletions go too, without live snapshots and bounds, unless ``ranges_too`` says that other files have rows under them.  A filter sees
    the newest stratum's values after the fold; what it removes becomes a deletion if older strata remain.
    """
    snapshots = sorted(set(snapshots))
    inside = F.lit(True)
    if lower is not None:
        inside &= F.col("key") >= F.lit(lower)
    if upper is not None:
        inside &= F.col("key") < F.lit(upper)
    rewritten = points(log).where(inside)
    untouched = points(log).where(~inside)
    if filter_ is not None:
        rewritten = filter_operands(rewritten, filter_)
    tombs = log.where(F.col("op") == RANGE_DELETE)
    op = operator(merge)
    rows = rewritten.select(*KEYS, "seq", "op", "value").withColumn("s", stratum(F.col("seq"), snapshots))
    # newest base of each stratum, and the newest tombstone of the same stratum over the key
    based = rows.groupBy(*KEYS, "s").agg(F.coalesce(F.max(F.when(F.col("op").isin(*BASES), F.col("seq"))), F.lit(-1)).alias("b"))
    t = tombstones(tombs).withColumn("s", stratum(F.col("seq"), snapshots))
    # a stratum is tested like a column family of its own
    width = F.lit(len(snapshots) + 1).cast("long")
    one = F.col("cf_id").cast("long") * width + F.col("s")
    covered = rangedel.cover(based.select(one.alias("cf_id"), "key"), t.select(one.alias("cf_id"), "start_key", "end_key", "seq"))
    covered = covered.select(F.floor(F.col("cf_id") / width).cast("int").alias("cf_id"), "key", (F.col("cf_id") % width).cast("int").alias("s"), F.col("cover_seq").alias("t"))
    floor = based.join(covered, [*KEYS, "s"], "left").withColumn("t", F.coalesce("t", F.lit(-1).cast("long")))
    joined = rows.join(floor, [*KEYS, "s"])
    base = (F.col("seq") == F.col("b")) & (F.col("b") >= F.col("t")) & F.col("op").isin(*BASES)
    operand = (F.col("op") == MERGE) & (F.col("seq") > F.col("b")) & (F.col("seq") >= F.col("t"))
    kept = joined.where(base | operand)
    # one aggregate: what a stratum folds to, and what it is made of
    has_ops = F.max(F.col("op") == MERGE)
    more = {"has_ops": has_ops, "floor": F.max(F.greatest("b", "t")), "top": F.max(F.struct("seq", "op", "value"))}
    each = F.collect_list(F.struct("seq", "op", "value"))
    if op is None:
        done = kept.groupBy(*KEYS, "s").agg(*[c.alias(n) for n, c in more.items()], each.alias("rows"))
        done = done.select(*KEYS, "s", F.explode(F.when(F.col("has_ops"), F.col("rows")).otherwise(F.array("top"))).alias("r"))
        out = done.select("cf_id", "key", "r.seq", "r.op", "r.value", "s")
    else:
        if not op.associative:
            more["rows"] = each
        done = folded(kept.select(*KEYS, "s", "seq", "op", "value", "b", "t"), op, by=[*KEYS, "s"], more=more)
        kind = F.when(F.col("floor") >= 0, F.lit(PUT)).otherwise(F.lit(MERGE)).cast("byte")
        fold = F.struct(F.col("seq"), kind.alias("op"), F.col("value"))
        floating = F.col("has_ops") & (F.col("floor") < 0)
        if op.associative:
            out = done.select(*KEYS, "s", F.when(F.col("has_ops"), fold).otherwise(F.col("top")).alias("r"))
        else:
            several = F.when(floating, F.col("rows")).when(F.col("has_ops"), F.array(fold)).otherwise(F.array("top"))
            out = done.select(*KEYS, "s", F.explode(several).alias("r"))
        out = out.select("cf_id", "key", "r.seq", "r.op", "r.value", "s")
    if filter_ is not None or full:
        # without snapshots there is one stratum, and nothing older
        out = out.withColumn("older", F.col("s") > F.min("s").over(Window.partitionBy(*KEYS)) if snapshots else F.lit(False))
    if filter_ is not None:
        newest = (F.col("s") == len(snapshots)) & (F.col("op") == PUT)
        out = out.withColumn("d", F.when(newest, filter_.decide(F.col("key"), F.col("value"))))
        removed = F.col("d") == REMOVE
        # rows of keys that lie under a kept tombstone or in older strata still need hiding
        out = out.withColumn("value", F.when(removed, F.lit(None)).when(F.col("d") == CHANGE, filter_.change(F.col("key"), F.col("value"))).otherwise(F.col("value")))
        out = out.withColumn("op", F.when(removed, DELETE).otherwise(F.col("op")).cast("byte"))
        if full:
            out = out.where(~F.coalesce(removed, F.lit(False)) | F.col("older"))
        out = out.drop("d")
    if full:
        gone = F.col("op").isin(*[b for b in BASES if b not in VALUES]) & ~F.col("older")
        out = out.where(~gone)
    made = out.select(*_row("cf_id", "key", F.col("seq"), F.col("op"), F.col("value")))
    if (full if ranges_too is None else ranges_too) and not snapshots and lower is None and upper is None:
        return made  # the fold has applied every tombstone, and nothing below remains
    return made.unionByName(untouched.select(made.columns)).unionByName(tombs.select(made.columns))


def factory(make, is_full: bool = True, is_manual: bool = True, cf_id: int = DEFAULT_CF) -> CompactionFilter:
    """A filter made for one rewrite."""
    return make(FilterContext(is_full, is_manual, cf_id))


# --- what to rewrite next, from a table of files


def pick_leveled(files: DataFrame, l0_trigger: int = L0_TRIGGER, base_bytes: int = BASE_BYTES) -> DataFrame:
    """A row for each level: score, and the largest file of the level with the best score at or above 1."""
    levels = files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.max(F.struct("size", (-F.col("file_number")).alias("m"))).alias("big"))
    target = F.lit(float(base_bytes)) * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("n_files") / F.lit(float(l0_trigger))).when(F.col("level") < LEVELS - 1, F.col("bytes") / target).otherwise(F.lit(0.0))
    levels = levels.withColumn("score", score)
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "level")
    picked = (F.row_number().over(best) == 1) & (F.col("score") >= 1)
    return levels.select("level", "n_files", "bytes", "score", picked.alias("picked"), F.when(picked & (F.col("level") > 0), -F.col("big.m")).alias("picked_file"))


def pick_fifo(files: DataFrame, now: int, ttl: int = 0, max_bytes: int = FIFO_BYTES) -> DataFrame:
    """Files to drop: those past ttl; without any, the oldest ones until the rest fits in max_bytes."""
    old = F.lit(False) if ttl <= 0 else F.col("created_at") + ttl < now
    marked = files.withColumn("expired", old)
    newest = Window.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), F.desc("file_number")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("kept_bytes", F.sum("size").over(newest)).withColumn("any_expired", F.max("expired").over(Window.partitionBy(F.lit(0))))
    drop = F.when(F.col("any_expired"), F.col("expired")).otherwise(F.col("kept_bytes") > max_bytes)
    return marked.select("file_number", "size", "created_at", "kept_bytes", drop.alias("drop"))


def intra_l0(files: DataFrame, trigger: int = L0_TRIGGER) -> DataFrame:
    """The oldest level-0 files to join among themselves, at most ten, if there are enough."""
    l0 = files.where("level = 0")
    order = Window.partitionBy("level").orderBy("created_at", "file_number")
    n = F.count("*").over(Window.partitionBy("level"))
    return l0.withColumn("r", F.row_number().over(order)).withColumn("n", n).where((F.col("n") >= trigger) & (F.col("r") <= INTRA_L0_FILES)).select("file_number", "size", "created_at")


def pick_universal(files: DataFrame, size_ratio: int = SIZE_RATIO, max_size_amp: int = MAX_SIZE_AMP, min_width: int = MIN_MERGE_WIDTH, max_width: int = MAX_MERGE_WIDTH) -> list[int]:
    """Sorted runs to merge, newest first, as file numbers of level 0 and -level of the others.

    Runs are few (a row for each level-0 file and for each level), so they are looked at on the driver.
    """
    run = F.when(F.col("level") == 0, F.col("file_number")).otherwise(-F.col("level").cast("long"))
    runs = files.groupBy(run.alias("run"), "level").agg(F.sum("size").alias("size"), F.max("largest_seq").alias("newest")).orderBy("level", F.desc("newest")).collect()
    if len(runs) < max(2, min_width):
        return []
    sizes = [r["size"] for r in runs]
    if sizes[0] and 100 * sum(sizes[1:]) > max_size_amp * sizes[0]:
        return [r["run"] for r in runs]
    for first in range(len(runs)):
        width, total = 1, sizes[first]
        while first + width < len(runs) and width < max_width and sizes[first + width] * 100 <= total * (100 + size_ratio):
            total += sizes[first + width]
            width += 1
        if width >= min_width:
            return [r["run"] for r in runs[first : first + width]]
    return []


def stall(memtables: Column, max_memtables: int, l0_files: Column) -> Column:
    """What writers are told: stop, delay or none."""
    return F.when(memtables >= max_memtables, "stop").when(l0_files >= STOP_FILES, "stop").when(l0_files >= SLOWDOWN_FILES, "delay").otherwise("none")
