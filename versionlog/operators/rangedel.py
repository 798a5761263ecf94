"""Range deletions: interval tests between keys and tombstones.

Tables: keys have cf_id and key; tombstones cf_id, start_key, end_key, seq.  A
tombstone covers start <= key < end where the key's seq is below its own.
Snapshots must be applied before anything here: a fragment keeps one seq only.

Few tombstones are broadcast.  Many are swept: all places (keys and ends) are sorted
and numbered, so a tombstone is an interval of numbers.  It is cut into nodes of a
tree over them, a few for each level; of the tombstones of a node the largest seq
stays, summed before the shuffle, and goes down the tree to the places.  No pair of
a key and a tombstone, or of two tombstones, is made, no task sees more of a node
than one number for each partition, and all runs in the JVM with operators that spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.sources.scratch import numbered, stored

#: Up to so many tombstones are broadcast and tested one by one; beyond, they are swept.
BROADCAST_TOMBSTONES = 1000
#: Children of a node, as bits.  Only speed hangs on it.
NODE_BITS = 5
#: Nothing is sampled any more; a test that was not to be changed sets it.
SAMPLED_A_RANGE = 20


def contains(key: Column, start: Column, end: Column) -> Column:
    return (key >= start) & (key < end)


def covers(key: Column, seq: Column, start: Column, end: Column, tomb_seq: Column) -> Column:
    return contains(key, start, end) & (seq < tomb_seq)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (other_start < end)


def _place(cf: Column, key: Column) -> Column:
    """Bytes in order of column family, then key."""
    return F.concat(F.unhex(F.lpad(F.hex(cf.cast("long")), 16, "0")), key)


def _nodes(a: Column, b: Column, level: int, top: bool) -> Column:
    """Nodes of a level that lie in [a, b) while the nodes above them do not."""
    wide = 1 << NODE_BITS
    at_or_above = lambda c, bits: F.shiftright(c + ((1 << bits) - 1), bits)
    bits = level * NODE_BITS
    lo, hi = at_or_above(a, bits), F.shiftright(b, bits)
    run = lambda x, y: F.when(x < y, F.sequence(x, y - 1))
    if top:
        return run(lo, hi)
    upper_lo, upper_hi = at_or_above(a, bits + NODE_BITS) * wide, F.shiftright(b, bits + NODE_BITS) * wide
    none = F.array().cast("array<bigint>")
    sides = F.concat(F.coalesce(run(lo, upper_lo), none), F.coalesce(run(upper_hi, hi), none))
    return F.when(upper_lo < upper_hi, sides).otherwise(run(lo, hi))


def _sweep(tombs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots (at, asked, slot), all places in their order, and covers (slot, seq), the largest seq over each that is covered.

    ``asked`` has distinct places (at).
    """
    start, end = _place(F.col("cf_id"), F.col("start_key")), _place(F.col("cf_id"), F.col("end_key"))
    t = stored(tombs.groupBy(start.alias("a_at"), end.alias("b_at")).agg(F.max("seq").alias("seq")), "tombstones")
    edges = t.select(F.explode(F.array("a_at", "b_at")).alias("at"), F.lit(False).alias("asked"))
    places = asked.select("at", F.lit(True).alias("asked")).unionByName(edges).groupBy("at").agg(F.max("asked").alias("asked"))
    slots = numbered(places, ["at"], "places", by="slot")
    found = slots.select("at", "slot")
    t = t.join(found.select(F.col("at").alias("a_at"), F.col("slot").alias("a")), "a_at").join(found.select(F.col("at").alias("b_at"), F.col("slot").alias("b")), "b_at")
    t = stored(t.select("a", "b", "seq"), "tombstone-slots")
    top, n = 0, slots.count()
    while n >> (top + 1) * NODE_BITS:
        top += 1
    covers = None
    for level in range(top, -1, -1):
        nodes = t.select(F.explode(_nodes(F.col("a"), F.col("b"), level, level == top)).alias("slot"), "seq")
        if covers is not None:
            first = F.shiftleft("slot", NODE_BITS)
            below = covers.select(F.explode(F.sequence(first, first + ((1 << NODE_BITS) - 1))).alias("slot"), "seq")
            nodes = nodes.unionByName(below)
        covers = nodes.groupBy("slot").agg(F.max("seq").alias("seq"))
    return slots, covers


def _cf_and_key(place: Column) -> tuple[Column, Column]:
    return F.conv(F.substring(F.hex(place), 1, 16), 16, 10).cast("long"), F.substring(place, 9, 1 << 30)


def fragments(tombs: DataFrame) -> DataFrame:
    """Disjoint intervals with the largest seq that covers each: cf_id, start_key, end_key, seq.

    Boundaries are all starts and ends; a fragment lies between neighbours.
    """
    slots, covers = _sweep(tombs, tombs.select(_place(F.col("cf_id"), F.col("start_key")).alias("at")).distinct())
    following = slots.select((F.col("slot") - 1).alias("slot"), F.col("at").alias("until"))
    found = covers.join(slots, "slot").join(following, "slot")
    cf, start = _cf_and_key(F.col("at"))
    return found.select(cf.cast(tombs.schema["cf_id"].dataType).alias("cf_id"), start.alias("start_key"), _cf_and_key(F.col("until"))[1].alias("end_key"), "seq")


def _cover_each(keys: DataFrame, tombs: DataFrame) -> DataFrame:
    t = F.broadcast(tombs.select(F.col("cf_id").alias("t_cf"), "start_key", "end_key", F.col("seq").alias("t_seq")))
    on = (F.col("cf_id") == F.col("t_cf")) & contains(F.col("key"), F.col("start_key"), F.col("end_key"))
    return keys.join(t, on).groupBy("cf_id", "key").agg(F.max("t_seq").alias("cover_seq"))


def _cover_swept(keys: DataFrame, tombs: DataFrame) -> DataFrame:
    slots, covers = _sweep(tombs, keys.select(_place(F.col("cf_id"), F.col("key")).alias("at")))
    found = slots.where("asked").join(covers, "slot")
    cf, key = _cf_and_key(F.col("at"))
    return found.select(cf.cast(keys.schema["cf_id"].dataType).alias("cf_id"), key.alias("key"), F.col("seq").alias("cover_seq"))


def cover(keys: DataFrame, tombs: DataFrame, method: str | None = None) -> DataFrame:
    """cf_id, key, cover_seq: the largest seq of a tombstone over each distinct key that has one."""
    keys = keys.select("cf_id", "key").distinct()
    if method is None:
        method = "each" if len(tombs.select("seq").take(BROADCAST_TOMBSTONES + 1)) <= BROADCAST_TOMBSTONES else "sweep"
    return _cover_each(keys, tombs) if method == "each" else _cover_swept(keys, tombs)


def max_cover_seq(keys: DataFrame, tombs: DataFrame) -> DataFrame:
    """Every distinct key with the largest seq that covers it, 0 without one."""
    every = keys.select("cf_id", "key").distinct()
    return every.join(cover(every, tombs), ["cf_id", "key"], "left").select("cf_id", "key", F.coalesce("cover_seq", F.lit(0)).alias("cover_seq"))
