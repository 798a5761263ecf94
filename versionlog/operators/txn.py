"""Transactions as properties of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.model import RANGE_DELETE, tombstones
from versionlog.operators import rangedel
from versionlog.sources.scratch import stored


def conflicts(tracked: DataFrame, log: DataFrame) -> DataFrame:
    """Tracked keys (txn_id, cf_id, key, seq) that a newer row of the log has written, point or range.

    Of the log only rows of tracked keys are aggregated.
    """
    asked = tracked.groupBy("cf_id", "key").agg(F.min("seq").alias("since"))
    rows = log.where(F.col("op") != RANGE_DELETE).select("cf_id", "key", F.col("seq").alias("w"))
    newest = rows.join(asked, ["cf_id", "key"]).where(F.col("w") > F.col("since")).groupBy("cf_id", "key").agg(F.max("w").alias("w"))
    hit = tracked.join(newest, ["cf_id", "key"]).where(F.col("w") > F.col("seq")).select("txn_id", "cf_id", "key", "seq", F.col("w").alias("newer_seq"))
    # a tombstone counts if the newest one over the key is newer, so the same lookup serves as for reads
    covered = rangedel.cover(tracked, tombstones(log))
    inside = tracked.join(covered, ["cf_id", "key"]).where(F.col("cover_seq") > F.col("seq")).select("txn_id", "cf_id", "key", "seq", F.col("cover_seq").alias("newer_seq"))
    return hit.unionByName(inside).groupBy("txn_id", "cf_id", "key", "seq").agg(F.max("newer_seq").alias("newer_seq"))


def validate(tracked: DataFrame, log: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every transaction (txn_id) with ``commits``: none of its tracked keys has a newer write."""
    lost = conflicts(tracked, log).groupBy("txn_id").agg(F.count("*").alias("n"))
    return transactions.join(lost, "txn_id", "left").select("txn_id", F.col("n").isNull().alias("commits"), F.coalesce("n", F.lit(0)).alias("n_conflicts"))


def committed(prepared: DataFrame, commits: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Rows of prepared transactions (with txn_id) that a snapshot sees.

    ``commits`` has txn_id, state (committed, prepared or rolled_back) and commit_seq; a row is
    visible if its transaction has committed at or before the snapshot, and counts at its commit.
    """
    done = commits.where(F.col("state") == "committed")
    if snapshot is not None:
        done = done.where(F.col("commit_seq") <= snapshot)
    done = done.select("txn_id", "commit_seq")
    return prepared.join(done, "txn_id").drop("txn_id")


def pending(commits: DataFrame) -> DataFrame:
    """Prepared transactions that recovery finds unresolved."""
    return commits.where(F.col("state") == "prepared").select("txn_id", "name")


def lock_conflicts(locks: DataFrame) -> DataFrame:
    """Waiters that cannot have their lock: waiter, cf_id, key, n_holders (of locks against theirs) and the first of these.

    Locks have txn_id, cf_id, key, exclusive, granted.  Shared locks go together; an exclusive one goes with none but
    its own transaction's.  Holders are counted by key, so a hot key gives a row for each waiter and no pairs.
    """
    by = ["cf_id", "key"]
    held = locks.where("granted").groupBy(*by, "txn_id").agg(F.max("exclusive").alias("x"))
    least = held.groupBy(*by).agg(F.min("txn_id").alias("a"), F.min(F.when(F.col("x"), F.col("txn_id"))).alias("a_x"), F.count("*").alias("n"), F.count_if("x").alias("n_x"))
    # the second least, for waiters that hold the least themselves
    rest = held.join(least, by).groupBy(*by).agg(F.min(F.when(F.col("txn_id") > F.col("a"), F.col("txn_id"))).alias("b"), F.min(F.when(F.col("x") & (F.col("txn_id") > F.col("a_x")), F.col("txn_id"))).alias("b_x"))
    asked = locks.where("not granted").groupBy(*by, "txn_id").agg(F.max("exclusive").alias("w_x"))
    own = held.select(*by, "txn_id", F.lit(1).alias("own"), F.col("x").alias("own_x"))
    met = asked.join(least, by).join(rest, by).join(own, [*by, "txn_id"], "left")
    mine, mine_x = F.coalesce("own", F.lit(0)), F.coalesce(F.col("own_x").cast("int"), F.lit(0))
    n = F.when(F.col("w_x"), F.col("n") - mine).otherwise(F.col("n_x") - mine_x)
    first = F.when(F.col("a") == F.col("txn_id"), F.col("b")).otherwise(F.col("a"))
    first_x = F.when(F.col("a_x") == F.col("txn_id"), F.col("b_x")).otherwise(F.col("a_x"))
    found = met.select(F.col("txn_id").alias("waiter"), *by, n.alias("n_holders"), F.when(F.col("w_x"), first).otherwise(first_x).alias("first_holder"))
    return found.where("n_holders > 0")


def waits(locks: DataFrame) -> DataFrame:
    """Pairs of a waiter and a holder, for a graph of waits.  A key's waiters and holders are all paired: keys with few."""
    held = locks.where("granted").select(F.col("txn_id").alias("holder"), "cf_id", "key", F.col("exclusive").alias("h_x"))
    asked = locks.where("not granted").select(F.col("txn_id").alias("waiter"), "cf_id", "key", F.col("exclusive").alias("w_x"))
    return asked.join(held, ["cf_id", "key"]).where((F.col("waiter") != F.col("holder")) & (F.col("h_x") | F.col("w_x"))).select("waiter", "holder").distinct()


def deadlocks(waits: DataFrame) -> DataFrame:
    """Transactions on a cycle of waits (waiter, holder), with their shortest cycle's length.

    First what cannot lie on a cycle goes, round by round: waits for one that waits for none, and of one that none
    waits for.  Then reachability grows by one wait a round, for waiters whose cycle is not found yet, and stops when
    nothing new is reached.  Rounds are stored.
    """
    edges = stored(waits.select("waiter", "holder").distinct(), "waits")
    n = edges.count()
    while n:
        ends = edges.select(F.col("waiter").alias("t")).intersect(edges.select(F.col("holder").alias("t")))
        ends = stored(ends, "waits-both")
        left = edges.join(ends.select(F.col("t").alias("waiter")), "waiter", "left_semi").join(ends.select(F.col("t").alias("holder")), "holder", "left_semi")
        edges = stored(left.select("waiter", "holder"), "waits")
        before, n = n, edges.count()
        if n == before:
            break
    front = seen = edges
    found, length = edges.where("waiter = holder").select(F.col("waiter").alias("txn_id"), F.lit(1).alias("length")), 1
    while not front.isEmpty():
        length += 1
        open_ = front.join(found.select(F.col("txn_id").alias("waiter")), "waiter", "left_anti")
        onward = open_.select("waiter", F.col("holder").alias("mid")).join(edges.select(F.col("waiter").alias("mid"), "holder"), "mid").select("waiter", "holder").distinct()
        front = stored(onward.join(seen, ["waiter", "holder"], "left_anti"), "waits-front")
        found = found.unionByName(front.where("waiter = holder").select(F.col("waiter").alias("txn_id"), F.lit(length).alias("length")))
        seen = seen.unionByName(front)
    return found
