"""Statistics of logs, files, metrics and traces."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versionlog.model import DELETE, MERGE, RANGE_DELETE, SINGLE_DELETE, InvalidInput
from versionlog.operators.compact import LEVELS
from versionlog.sources.scratch import numbered, stored

#: Rows that a task of the collision check groups, about.
ROWS_A_PARTITION = 200_000


def entry_stats(log: DataFrame) -> DataFrame:
    """One row: counts by kind, seq range, key and value bytes."""
    kinds = {"deletes": (DELETE, SINGLE_DELETE), "merges": (MERGE,), "range_dels": (RANGE_DELETE,)}
    return log.agg(
        F.count("*").alias("num_entries"),
        *[F.count_if(F.col("op").isin(*ops)).alias(f"num_{k}") for k, ops in kinds.items()],
        F.min("seq").alias("smallest_seq"),
        F.max("seq").alias("largest_seq"),
        F.sum(F.length("key").cast("long")).alias("raw_key_bytes"),
        F.coalesce(F.sum(F.length("value").cast("long")), F.lit(0)).alias("raw_value_bytes"),
    )


def table_stats(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries, bytes, averages and key range of a file's rows (or of each group)."""
    size = F.length("key").cast("long"), F.coalesce(F.length("value").cast("long"), F.lit(0).cast("long"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("entries"), F.sum(size[0]).alias("key_bytes"), F.sum(size[1]).alias("value_bytes"), F.avg(size[0]).alias("avg_key"), F.avg(size[1]).alias("avg_value"), F.min("key").alias("smallest"), F.max("key").alias("largest")
    )


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def files_at_level(files: DataFrame, level: int) -> int:
    if not 0 <= level < LEVELS:
        raise InvalidInput(f"no level {level}")
    return files.where(F.col("level") == level).count()


def estimate_keys(files: DataFrame) -> DataFrame:
    """A hundredth of each file's bytes, in whole numbers."""
    return files.agg(F.coalesce(F.sum(F.floor(F.col("size") / 100)), F.lit(0)).cast("long").alias("estimated_keys"))


def approximate_sizes(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bytes of files that overlap each range (range_id, start_key, end_key), a whole file at a time; ranges are half open."""
    hit = (F.col("smallest") < F.col("end_key")) & (F.col("largest") >= F.col("start_key"))
    joined = ranges.join(files.select("smallest", "largest", "size"), hit, "left")
    return joined.groupBy("range_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("size").alias("n_files"))


def collisions(log: DataFrame) -> DataFrame:
    """Internal keys with more than one value.

    Nearly all keys differ, so rows go to their partitions first, about as many to each whatever the log's
    size: partial aggregates and joined partitions would hold a part of the log that grows with it.
    """
    n = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-log.count() // ROWS_A_PARTITION))
    same = log.repartition(n, "key", "seq").groupBy("cf_id", "key", "seq", "op").agg(F.count_distinct(F.coalesce(F.hex("value"), F.lit("-"))).alias("n_values"), F.count("*").alias("n_rows"))
    return same.where("n_values > 1")


def histogram(values: DataFrame, name: str, value: str) -> DataFrame:
    """Count, sum, min, max, average, percentiles and deviation of each metric."""
    v = F.col(value)
    told = values.groupBy(name).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("average"), F.stddev_pop(v).alias("deviation"))
    found = quantiles(values, name, value, {"median": "0.5", "p95": "0.95", "p99": "0.99"}).withColumnRenamed(name, "__name")
    joined = told.join(found, F.col(name).eqNullSafe(F.col("__name")), "left")
    return joined.select(name, "n", "total", "least", "most", "average", "median", "p95", "p99", "deviation")


def quantiles(values: DataFrame, name: str, value: str, wanted: dict[str, str]) -> DataFrame:
    """Exact discrete quantiles of each metric: the least value with at least a share q of the values at or below it.

    ``wanted`` has columns' names and shares as decimal texts.  Counts of values are sorted into ranges; of
    each range only a count for each of its metrics goes to the others, so no task sees a whole metric.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(name).alias("m"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranged = stored(counts.repartitionByRange("m", "v").withColumn("part", F.spark_partition_id()), "quantiles")
    each = Window.partitionBy("m")
    sizes = ranged.groupBy("m", "part").agg(F.sum("c").alias("c"))
    before = F.coalesce(F.sum("c").over(each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("m").alias("s_m"), F.col("part").alias("s_part"), before.alias("before"), F.sum("c").over(each).alias("n"))
    joined = ranged.join(sizes, F.col("m").eqNullSafe(F.col("s_m")) & (F.col("part") == F.col("s_part")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("part", "m").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = joined.select("m", "v", "c", "n", upto.alias("upto"))

    def at(share: str) -> Column:
        top, bottom = Decimal(share).as_integer_ratio()
        place = F.greatest(F.lit(1).cast("long"), F.expr(f"(n * {top} + {bottom - 1}) div {bottom}"))
        return F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place), F.col("v")))

    return placed.groupBy(F.col("m").alias(name)).agg(*[at(q).alias(k) for k, q in wanted.items()])


def tickers(metrics: DataFrame) -> DataFrame:
    """Counters from (ticker, seq, action, n): ``add`` counts up from the last ``set``, whose n it starts at."""
    start = metrics.where(F.col("action") == "set").groupBy("ticker").agg(F.max(F.struct("seq", "n")).alias("s"))
    joined = metrics.join(start, "ticker", "left")
    added = F.when((F.col("action") == "add") & (F.col("s").isNull() | (F.col("seq") > F.col("s.seq"))), F.col("n")).otherwise(0)
    return joined.groupBy("ticker").agg((F.coalesce(F.max("s.n"), F.lit(0)) + F.sum(added)).alias("value"))


def snapshot_stats(snapshots: DataFrame) -> DataFrame:
    """Live snapshots (seq, created_at): how many, and when the one with the smallest seq was made (0 without any)."""
    return snapshots.agg(F.count("*").alias("n_snapshots"), F.coalesce(F.min_by("created_at", "seq"), F.lit(0)).alias("oldest_time"))


def trace_stats(trace: DataFrame) -> DataFrame:
    """A row for each type, with the whole trace's total, span and rate beside it (types are few)."""
    types = trace.groupBy("type").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    every = Window.partitionBy(F.lit(0))
    span = F.max("last_ns").over(every) - F.min("first_ns").over(every)
    total = F.sum("n").over(every)
    return types.select("type", "n", total.alias("total"), span.alias("span_ns"), F.when(span > 0, total * 1e9 / span).otherwise(F.lit(0.0)).alias("per_second"))


def state_digest(state: DataFrame, sample: int = 0) -> DataFrame:
    """Number of keys and a digest that depends on their order.

    Each row's bytes of key and value are XORed into one byte, shifted by the row's place modulo
    eight, and all rows XORed.  Places come from counts of stored ranges, so no task sees all rows
    and places and counts are of the same ranges.  With
    ``sample`` only every n-th row counts, n = rows / sample.
    """
    x = _xor_bytes(F.concat("key", F.coalesce("value", F.lit(b""))))
    placed = numbered(state.select("cf_id", "key", x.alias("x")), ["cf_id", "key"], "digest")
    n_keys = F.count("*")
    if sample:
        rows = placed.count()
        placed = placed.where(F.col("place") % max(1, rows // sample) == 0)
        n_keys = F.lit(rows).cast("long")
    shifted = F.call_function("shiftleft", F.col("x"), ((F.col("place") % 8) * 8).cast("int"))
    return placed.agg(n_keys.alias("n_keys"), F.coalesce(F.bit_xor(shifted), F.lit(0)).alias("digest"))


def _xor_bytes(raw: Column) -> Column:
    """All bytes of a value XORed into one."""
    digits = F.hex(raw)
    places = F.sequence(F.lit(0), F.greatest(F.length(raw) - 1, F.lit(0)))
    byte = lambda k: F.coalesce(F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).try_cast("long"), F.lit(0).cast("long"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda done, k: done.bitwiseXOR(byte(k)))


def properties(log: DataFrame, files: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Named integers of a store as a long table: name, value."""
    entries = entry_stats(log)
    named = [F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in ("num_entries", "num_deletes", "num_merges", "num_range_dels", "largest_seq")]
    out = entries.select(F.explode(F.array(*named)).alias("p")).select("p.name", "p.value")
    totals = files.agg(F.count("*").alias("live_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_file_bytes"), F.coalesce(F.sum(F.floor(F.col("size") / 100)), F.lit(0)).alias("estimate_num_keys"), *[F.count_if(F.col("level") == k).alias(f"num_files_at_level{k}") for k in range(LEVELS)])
    named = [F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in totals.columns]
    out = out.unionByName(totals.select(F.explode(F.array(*named)).alias("p")).select("p.name", "p.value"))
    if snapshots is not None:
        s = snapshot_stats(snapshots)
        named = [F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in ("n_snapshots", "oldest_time")]
        out = out.unionByName(s.select(F.explode(F.array(*named)).alias("p")).select("p.name", "p.value"))
    return out


def int_property(table: DataFrame, name: str) -> int | None:
    rows = table.where(F.col("name") == name).take(1)
    return rows[0]["value"] if rows else None


def map_property(table: DataFrame) -> dict[str, int]:
    """The named integers, of which there are a few dozen."""
    return {r["name"]: r["value"] for r in table.collect()}


def dump(rows: DataFrame, hexed: bool = False) -> DataFrame:
    """Rows for reading: key and value as text or hexadecimal digits."""
    show = (lambda c: F.lower(F.hex(c))) if hexed else (lambda c: F.decode(c, "UTF-8"))
    return rows.withColumn("key", show("key")).withColumn("value", show("value"))


def verify_values(state: DataFrame) -> DataFrame:
    """Keys whose test value is wrong in any byte: LE64 key, LE32 id, then at place i from 12 on (key + id + i) mod 256."""
    from versionlog.functions.codecs import decode_u64le

    number = F.regexp_extract(F.decode("key", "UTF-8"), "([0-9]+)$", 1).try_cast("decimal(20,0)")
    head = decode_u64le(F.substring("value", 1, 8))
    digits = F.hex("value")
    byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).try_cast("long")
    ident = byte(F.lit(8)) + byte(F.lit(9)) * 256 + byte(F.lit(10)) * 65536 + byte(F.lit(11)) * 16777216
    base = (number % 256).cast("long") + ident
    places = F.sequence(F.lit(12), F.greatest(F.length("value") - 1, F.lit(12)))
    wrong = F.exists(places, lambda k: (k < F.length("value")) & (byte(k) != (base + k) % 256))
    return state.where(number.isNull() | (F.length("value") < 12) | F.coalesce((head != number) | wrong, F.lit(True)))
