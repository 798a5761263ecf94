import random

import pytest
from model import collected, frame, interpret, random_log, u64
from pyspark.sql import functions as F

from versionlog.model import DELETE, MERGE, PUT, RANGE_DELETE, points, tombstones
from versionlog.operators import compact, filters, merge, rangedel, scan
from versionlog.operators.resolve import latest, resolve


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("append", [False, True])
def test_matches_interpreter_at_snapshots(spark, seed, append):
    rows = random_log(seed, append=append)
    log = frame(spark, rows).cache()
    name = "string_append" if append else "uint64_add"
    for snapshot in (None, 30, 77):
        assert collected(resolve(log, snapshot, name)) == interpret(rows, snapshot, append)


@pytest.mark.parametrize("seed", range(2))
def test_compaction_keeps_every_live_snapshot(spark, seed):
    for append in (False, True):
        rows = random_log(seed + 10, append=append)
        name = "string_append" if append else "uint64_add"
        log = frame(spark, rows)
        small = compact.compact(log, (25, 60, 90), name).cache()
        assert small.count() < len(rows)
        for snapshot in (25, 60, 90, None):
            assert collected(resolve(small, snapshot, name)) == interpret(rows, snapshot, append)
        full = compact.compact(log, (), name, full=True)
        assert collected(resolve(full, None, name)) == interpret(rows, None, append)
        assert full.where(f"op in ({DELETE}, {RANGE_DELETE})").count() == 0


def test_full_compaction_with_snapshots_keeps_hidden_versions(spark):
    rows = [(0, b"a", 1, PUT, b"1", None), (0, b"a", 5, DELETE, None, None), (0, b"b", 6, DELETE, None, None), (0, b"a", 9, PUT, b"2", None)]
    small = compact.compact(frame(spark, rows), (3, 7), full=True)
    for snapshot in (3, 7, None):
        assert collected(resolve(small, snapshot)) == interpret(rows, snapshot)
    assert small.where("key = X'62'").count() == 0


def test_compaction_filter_spares_snapshots(spark):
    rows = [(0, b"a", 1, PUT, b"1", None), (0, b"a", 5, PUT, b"2", None), (0, b"b", 6, PUT, b"3", None)]
    small = compact.compact(frame(spark, rows), (3,), filter_=filters.remove_by_prefix(b"a"))
    assert collected(resolve(small, 3)) == {(0, b"a"): b"1"}
    assert collected(resolve(small)) == {(0, b"b"): b"3"}


def test_compaction_of_a_range_leaves_the_rest(spark):
    rows = random_log(3)
    small = compact.compact(frame(spark, rows), (), "uint64_add", lower=b"k02", upper=b"k05")
    assert collected(resolve(small, None, "uint64_add")) == interpret(rows)
    assert small.where("key >= 'k05' and op <> 15").count() == sum(r[1] >= b"k05" and r[3] != RANGE_DELETE for r in rows)


CASES = [
    ([(0, b"k", 1, PUT, u64(100), None), *[(0, b"k", 2 + i, MERGE, u64(10), None) for i in range(5)]], u64(150)),
    ([(0, b"k", 1, PUT, u64(100), None), (0, b"k", 2, MERGE, u64(50), None), (0, b"k", 3, DELETE, None, None), (0, b"k", 4, MERGE, u64(25), None)], u64(25)),
    ([(0, b"k", 1, PUT, u64((1 << 64) - 1), None), (0, b"k", 2, MERGE, u64(2), None)], u64(1)),
    ([(0, b"k", 1, PUT, b"odd", None)], b"odd"),
    ([(0, b"k", 3, PUT, u64(7), None), (0, b"a", 2, RANGE_DELETE, None, b"z")], u64(7)),
    ([(0, b"k", 1, PUT, u64(7), None), (0, b"a", 2, RANGE_DELETE, None, b"z"), (0, b"k", 3, MERGE, u64(1), None)], u64(1)),
    ([(0, b"k", 2, PUT, u64(7), None), (0, b"k", 2, RANGE_DELETE, None, b"k\0")], u64(7)),
    ([(0, b"k", 1, PUT, u64(7), None), (0, b"z", 2, RANGE_DELETE, None, b"a")], u64(7)),
    ([(0, b"k", 1, PUT, u64(7), None), (1, b"a", 2, RANGE_DELETE, None, b"z")], u64(7)),
]


@pytest.mark.parametrize("rows, expected", CASES)
def test_counter_cases(spark, rows, expected):
    assert collected(resolve(frame(spark, rows), merge="uint64_add")) == {(0, b"k"): expected}


APPENDS = [(None, [b"a", b"b"], b"a,b"), (b"base", [b""], b"base"), (b"", [b"b", b"c"], b"b,c"), (b"", [b""], b""), (b"existing", [], b"existing"), (None, [b"\xff", b"\0"], b"\xff,\0")]


@pytest.mark.parametrize("base, operands, expected", APPENDS)
def test_append_cases(spark, base, operands, expected):
    rows = [(0, b"k", 1, PUT, base, None)] * (base is not None) + [(0, b"k", 2 + i, MERGE, v, None) for i, v in enumerate(operands)]
    assert collected(resolve(frame(spark, rows), merge="string_append")) == {(0, b"k"): expected}


def test_merge_failures(spark):
    log = frame(spark, [(0, b"k", 1, PUT, b"odd", None), (0, b"k", 2, MERGE, u64(1), None)])
    with pytest.raises(Exception, match="MergeFailed"):
        resolve(log, merge="uint64_add").collect()
    assert resolve(log, merge="uint64_add", on_error="null").first().value is None
    with pytest.raises(Exception, match="NoMergeOperator"):
        resolve(log).collect()


def test_custom_and_associative_operators(spark):
    rows = [(0, b"k", 1, PUT, b"x", None), (0, b"k", 2, MERGE, b"y", None), (0, b"k", 3, MERGE, b"z", None), (0, b"p", 4, PUT, b"q", None)]
    log = frame(spark, rows)
    backwards = merge.custom("backwards", lambda key, base, ops: b"".join(reversed(ops)) + (base or b""))
    assert collected(resolve(log, merge=backwards)) == {(0, b"k"): b"zyx", (0, b"p"): b"q"}
    glued = merge.associative("glued", lambda a, b: F.concat(a, b))
    assert collected(resolve(log, merge=glued)) == {(0, b"k"): b"xyz", (0, b"p"): b"q"}
    biggest = resolve(log, merge="max")
    assert collected(biggest) == {(0, b"k"): b"z", (0, b"p"): b"q"}


@pytest.mark.parametrize("seed", range(3))
def test_fragments_equal_interval_join(spark, seed):
    log = frame(spark, random_log(seed + 30, n=200, keys=30))
    keys, tombs = points(log), tombstones(log).cache()
    each = {tuple(r) for r in rangedel.cover(keys, tombs, "each").collect()}
    assert each == {tuple(r) for r in rangedel.cover(keys, tombs, "sweep").collect()}
    assert each


def test_empty_log_and_edge_keys(spark):
    log = frame(spark, [])
    assert resolve(log).count() == 0 and latest(log).count() == 0 and compact.compact(log).count() == 0
    rows = [(0, b"", 1, PUT, b"", None), (0, b"\0", 2, PUT, b"0", None), (0, b"\xff", 3, PUT, b"f", None), (0, b"a", 4, PUT, b"1", None), (0, b"ab", 5, PUT, b"2", None)]
    assert collected(resolve(frame(spark, rows))) == interpret(rows)
    order = [bytes(r.key) for r in scan.scan(frame(spark, rows)).collect()]
    assert order == sorted(order)


def test_reads_agree(spark):
    rows = random_log(5)
    log, want = frame(spark, rows), interpret(rows)
    forward = [(r.cf_id, bytes(r.key)) for r in scan.scan(log, merge="uint64_add").collect()]
    assert forward == sorted(want)
    assert [(r.cf_id, bytes(r.key)) for r in scan.scan(log, reverse=True, merge="uint64_add").collect()] == forward[::-1]
    for k in (b"k00", b"k03", b"k99"):
        got = collected(scan.get(log, k, 1, merge="uint64_add"))
        assert got == {x: v for x, v in want.items() if x == (1, k)}
    inside = collected(scan.scan(log, b"k02", b"k05", merge="uint64_add"))
    assert inside == {x: v for x, v in want.items() if b"k02" <= x[1] < b"k05"}
    probes = spark.createDataFrame([(0, b"k01"), (1, b"nope"), (2, b"k01")], "pos int, key binary")
    found = scan.multi_get(log, probes, merge="uint64_add").collect()
    assert [r.pos for r in found] == [0, 1, 2] and found[1].found is False and found[0].value == found[2].value
    one = [bytes(r.key) for r in scan.seek(log, b"k03", cfs=[0], merge="uint64_add").collect()]
    assert one == [min(k for cf, k in want if cf == 0 and k >= b"k03")]
    state = resolve(log, merge="uint64_add").where("cf_id = 0")
    keys = sorted(bytes(r.key) for r in state.collect())
    got = [(r.prev_key and bytes(r.prev_key), bytes(r.key), r.next_key and bytes(r.next_key)) for r in scan.neighbours(state).orderBy("key").collect()]
    assert got == list(zip([None, *keys], keys, [*keys[1:], None]))


@pytest.mark.parametrize("seed", range(2))
def test_sweep_matches_interval_tests(spark, monkeypatch, seed):
    monkeypatch.setattr(rangedel, "SAMPLED_A_RANGE", 3)
    rng = random.Random(seed)
    key = lambda: b"%c" % rng.randrange(97, 101) * rng.randrange(0, 3) + b"%d" % rng.randrange(30)
    tombs = [(rng.randrange(3), *sorted((key(), key())), rng.randrange(1, 99)) for _ in range(120)]
    tombs = [t for t in tombs if t[1] < t[2]]
    t = spark.createDataFrame(tombs, "cf_id int, start_key binary, end_key binary, seq long")
    asked = {(rng.randrange(4), key()) for _ in range(300)}
    got = {(r.cf_id, bytes(r.key)): r.cover_seq for r in rangedel.cover(spark.createDataFrame(list(asked), "cf_id int, key binary"), t, "sweep").collect()}
    over = {(c, k): [s for cf, a, b, s in tombs if cf == c and a <= k < b] for c, k in asked}
    assert got == {at: max(s) for at, s in over.items() if s}
    edges = {c: sorted({k for cf, a, b, _ in tombs if cf == c for k in (a, b)}) for c in range(3)}
    want = set()
    for c, points_ in edges.items():
        for lo, hi in zip(points_, points_[1:]):
            if over_ := [s for cf, a, b, s in tombs if cf == c and a <= lo and hi <= b]:
                want.add((c, lo, hi, max(over_)))
    assert {(r.cf_id, bytes(r.start_key), bytes(r.end_key), r.seq) for r in rangedel.fragments(t).collect()} == want


def test_many_tombstones_make_no_pairs(spark):
    n = 100_000
    name = lambda c: F.encode(F.lpad(c.cast("string"), 7, "0"), "UTF-8")
    k = F.col("id")
    # every thousandth covers a tenth of the keys
    width = F.when(k % 1000 == 0, n // 10).otherwise(5)
    tombs = spark.range(n).select(F.lit(0).alias("cf_id"), name(k).alias("start_key"), name(k + width).alias("end_key"), (k * 7919 % 100_003).alias("seq"))
    keys = spark.range(0, n, 10).select(F.lit(0).alias("cf_id"), name(k).alias("key"))
    covered = rangedel.cover(keys, tombs)
    assert "NestedLoop" not in covered._jdf.queryExecution().toString() and "Cartesian" not in covered._jdf.queryExecution().toString()
    got = {int(bytes(r.key)): r.cover_seq for r in covered.collect()}
    seq = lambda j: j * 7919 % 100_003
    for key in random.Random(1).sample(range(0, n, 10), 300):
        near = [seq(j) for j in range(max(0, key - 4), key + 1)]
        far = [seq(j) for j in range(0, key + 1, 1000) if key < j + n // 10]
        assert got[key] == max(near + far)
    assert len(got) == n // 10


@pytest.mark.parametrize("bits", (1, 2, 5))
def test_sweep_needs_no_python_workers(spark, monkeypatch, bits):
    """Trees of several heights, long and short intervals, all in the JVM."""
    monkeypatch.setattr(rangedel, "NODE_BITS", bits, raising=False)
    rng = random.Random(bits)
    name = lambda j: b"%04d" % j
    tombs = []
    for _ in range(300):
        a = rng.randrange(500)
        tombs.append((rng.randrange(2), a, a + rng.choice([1, 2, 3, 40, 300]), rng.randrange(1000)))
    t = spark.createDataFrame([(c, name(a), name(b), s) for c, a, b, s in tombs], "cf_id int, start_key binary, end_key binary, seq long")
    asked = [(c, j) for c in range(3) for j in range(0, 900, 3)]
    covered = rangedel.cover(spark.createDataFrame([(c, name(j)) for c, j in asked], "cf_id int, key binary"), t, "sweep")
    plan = covered._jdf.queryExecution().toString() + rangedel.fragments(t)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
    over = {(c, name(j)): [s for cf, a, b, s in tombs if cf == c and a <= j < b] for c, j in asked}
    assert {(r.cf_id, bytes(r.key)): r.cover_seq for r in covered.collect()} == {k: max(s) for k, s in over.items() if s}


def test_large_column_family_ids_in_a_rewrite(spark):
    big = (1 << 31) - 2
    rows = [(big, b"a", 1, PUT, u64(1), None), (big, b"a", 5, MERGE, u64(2), None), (big, b"b", 6, RANGE_DELETE, None, b"c"), (0, b"a", 9, PUT, u64(3), None)]
    small = compact.compact(frame(spark, rows), (3, 7), "uint64_add")
    for snapshot in (3, 7, None):
        assert collected(resolve(small, snapshot, "uint64_add")) == interpret(rows, snapshot)


def test_a_rewrite_has_one_fold(spark, tmp_path):
    frame(spark, random_log(5)).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = compact.compact(log, merge="uint64_add", full=True)._jdf.queryExecution().optimizedPlan().toString()
    # rows, the newest base of each key, and the same again under the tombstones, which are one more
    assert plan.count("Relation [") <= 4


def test_counters_wrap_for_large_values(spark, tmp_path):
    """A value that passes 2^63 with the constant added is no error."""
    from versionlog.plans.catalogue import merge_counter_wrap

    rows = [(0, 1, "view", 1000.5), (1, 1, "click", 3.0), (2, 2, "error", 807.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in merge_counter_wrap(spark, str(tmp_path)).select("key", "total", "seq").collect()}
    base = 9223372036854775000
    assert got == {("u000001", str((2 * base + 1003) % 2**64), 2), ("u000002", str(base + 807), 3)}


def test_histogram_has_exact_percentiles(spark):
    """Beyond the accuracy of a sketch; also few values, equal ones, null names and names without values."""
    import math

    from versionlog.operators import inspect

    rng = random.Random(5)
    groups = {"many": [rng.random() for _ in range(60000)], "few": [3.0, 1.0, 2.0], "one": [7.0], "equal": [2.0] * 50 + [1.0] * 50, None: [4.0, 5.0], "nothing": [None]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    got = {r.metric: (r.n, r.median, r.p95, r.p99) for r in inspect.histogram(spark.createDataFrame(rows, "metric string, value double"), "metric", "value").collect()}
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        places = [math.ceil(len(vs) * p / 100) - 1 for p in (50, 95, 99)]
        assert got[k] == (len(vs), *[vs[p] if vs else None for p in places])


def test_digest_of_many_keys(spark):
    """More keys than a sample of ranges takes whole: places and counts are of the same ranges."""
    from functools import reduce
    from operator import xor

    from versionlog.operators import inspect

    n = 300000
    state = spark.range(n).select(F.lit(0).alias("cf_id"), F.encode(F.concat(F.lit("k"), F.lpad(((F.col("id") * 7919) % n).cast("string"), 8, "0")), "UTF-8").alias("key"), F.encode(((F.col("id") * 7919) % n % 97).cast("string"), "UTF-8").alias("value"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = inspect.state_digest(state).collect()
        some = inspect.state_digest(state, sample=1000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    byte = lambda k: reduce(xor, b"k%08d" % k + str(k % 97).encode())
    fold = lambda places: reduce(xor, (byte(k) << k % 8 * 8 for k in places))
    assert tuple(got[0]) == (n, fold(range(n)))
    assert tuple(some[0]) == (n, fold(range(0, n, 300)))


def test_codecs_compute_a_value_once(spark):
    """Bytes are turned without naming the value for each of them, so nested codecs do not multiply."""
    from versionlog.functions import codecs
    from versionlog.operators import timetravel

    rows = [(n, t) for n, t in zip([b"", b"v", b"\x00" * 9, b"\xff" * 3], [0, 1, 1706745599, (1 << 63) - 1])]
    t = spark.createDataFrame(rows, "v binary, t long").withColumn("value", codecs.append_expiry_base(F.col("v"), F.col("t")))
    left = timetravel.alive_values(t.withColumn("was", F.col("value")).withColumn("at", codecs.created_at_of(F.col("value"))), 0, 0)
    assert {(bytes(r.v), r.t, bytes(r.was), bytes(r.value), r.at) for r in left.collect()} == {(v, t, v + t.to_bytes(8, "little"), v, t) for v, t in rows}
    short = spark.createDataFrame([(b"1234567",), (None,)], "value binary").select(codecs.created_at_of(F.col("value")).alias("at"), codecs.decode_u64le(F.col("value")).alias("n"))
    assert [tuple(r) for r in short.collect()] == [(None, None)] * 2
    top = spark.range(1).select(F.lit(str((1 << 64) - 1)).cast("decimal(20,0)").alias("n")).select(codecs.decode_u64le(codecs.encode_u64le(F.col("n"))).alias("n"))
    assert int(top.first().n) == (1 << 64) - 1
    plan = timetravel.alive_values(t.select("value"), 10, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") <= 10


def test_collisions_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """A task's share does not grow with the log; equal and missing values count as one each."""
    from versionlog.operators import inspect

    monkeypatch.setattr(inspect, "ROWS_A_PARTITION", 100, raising=False)
    rows = [(0, b"k%d" % k, k % 50, PUT, v, None) for k in range(500) for v in (b"a", b"a", None, b"b" if k % 5 else b"a")]
    found = inspect.collisions(frame(spark, rows).withColumn("op", F.lit(PUT).cast("byte")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and ", 20)" in plan.split("Exchange hash")[1].split("\n")[0] and "REPARTITION_BY_NUM" in plan
    assert {(bytes(r.key), r.n_values, r.n_rows) for r in found.collect()} == {(b"k%d" % k, 3 if k % 5 else 2, 4) for k in range(500)}
