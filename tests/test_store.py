import random
import time

import pytest
from model import collected, frame, u64
from pyspark.sql import functions as F

from versionlog.functions import codecs
from versionlog.model import PUT, Conflict, InvalidInput, NotFound, ReadOnly
from versionlog.operators import ingest, timetravel, txn, wide
from versionlog.operators.batch import WriteBatch
from versionlog.operators.resolve import resolve
from versionlog.sources.store import Backups, Store
from versionlog.streaming import cdc, listeners


def test_store_round_trip(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), merge="uint64_add")
    assert s.write(WriteBatch().put(b"a", u64(1)).merge(b"a", u64(2)).put(b"b", u64(5))) == 1
    snap = s.snapshot()
    s.write(WriteBatch().delete_range(b"a", b"b").merge(b"b", u64(1)))
    assert collected(s.state()) == {(0, b"b"): u64(6)}
    assert collected(s.state(snap)) == {(0, b"a"): u64(3), (0, b"b"): u64(5)}
    reader = Store(spark, str(tmp_path / "s"), merge="uint64_add", read_only=True)
    with pytest.raises(ReadOnly):
        reader.write(WriteBatch().put(b"x", b"y"))
    s.compact()
    s.vacuum()
    assert collected(s.state(snap)) == {(0, b"a"): u64(3), (0, b"b"): u64(5)}
    assert collected(s.state()) == {(0, b"b"): u64(6)}
    s.release(snap)
    s.compact()
    assert s.log().count() == 1
    assert collected(Store(spark, str(tmp_path / "s"), "uint64_add").state()) == {(0, b"b"): u64(6)}
    reader.refresh()
    assert s.files_table().agg(F.sum("num_entries")).first()[0] == 1
    assert s.sorted_logs().count() == 1


def test_two_writers_conflict(spark, tmp_path):
    a = Store(spark, str(tmp_path / "s"))
    b = Store(spark, str(tmp_path / "s"))
    a.write(WriteBatch().put(b"k", b"1"))
    with pytest.raises(Conflict):
        b.write(WriteBatch().put(b"k", b"2"))
    tracked = spark.createDataFrame([(1, 0, b"k", 0)], "txn_id int, cf_id int, key binary, seq long")
    with pytest.raises(Conflict):
        b.commit_transaction(WriteBatch().put(b"k", b"3"), tracked)
    b.commit_transaction(WriteBatch().put(b"k", b"3"), tracked.withColumn("seq", F.lit(1).cast("long")))
    assert collected(b.state()) == {(0, b"k"): b"3"}


def test_column_families_and_options(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    cf = s.create_cf("other")
    with pytest.raises(InvalidInput):
        s.create_cf("other")
    with pytest.raises(InvalidInput):
        s.drop_cf("default")
    s.write(WriteBatch().put(b"k", b"0").put(b"k", b"1", cf=cf))
    assert collected(s.state()) == {(0, b"k"): b"0", (cf, b"k"): b"1"}
    out = s.export_cf("other", str(tmp_path / "e"))
    assert collected(out.state()) == {(cf, b"k"): b"1"}
    s.drop_cf("other")
    with pytest.raises(NotFound):
        s.write(WriteBatch().put(b"k", b"1", cf=cf))
    assert s.set_options({"max_background_jobs": "4", "unknown": "x"}) == {"max_background_jobs": "4"}
    with pytest.raises(InvalidInput):
        s.set_options({"max_background_jobs": "many"})


def test_backups(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    backups = Backups(spark, str(tmp_path / "b"))
    for n in range(3):
        s.write(WriteBatch().put(b"k", b"%d" % n))
        backups.create(s)
    assert backups.list() == [1, 2, 3]
    assert collected(backups.restore(2, str(tmp_path / "r")).state()) == {(0, b"k"): b"1"}
    assert backups.purge(1) == [1, 2]
    with pytest.raises(NotFound):
        backups.delete(1)
    with pytest.raises(InvalidInput):
        s.checkpoint(str(tmp_path / "r"))


def test_ingestion(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.write(WriteBatch().put(b"a", b"old"))
    rows = spark.createDataFrame([(b"a", PUT, b"new", None), (b"b", PUT, b"new", None)], "key binary, op int, value binary, end_key binary")
    s.ingest([rows], ingest.IngestOptions(behind=True))
    assert collected(s.state()) == {(0, b"a"): b"old", (0, b"b"): b"new"}
    s.ingest([rows])
    assert collected(s.state()) == {(0, b"a"): b"new", (0, b"b"): b"new"}
    with pytest.raises(InvalidInput):
        s.ingest([rows], ingest.IngestOptions(fail_if_not_bottommost=True))
    with pytest.raises(InvalidInput):
        s.ingest([rows.limit(0)])


def test_stream_materialises_state(spark, tmp_path):
    log = tmp_path / "log"
    frame(spark, [(0, b"a", 1, PUT, u64(1), None), (0, b"a", 3, 2, u64(5), None), (0, b"b", 4, PUT, u64(7), None), (0, b"c", 5, PUT, u64(9), None)]).write.parquet(str(log))
    states = []
    for more in ([(0, b"a", 2, 2, u64(10), None), (0, b"a", 3, 2, u64(5), None)], [(0, b"b", 6, 15, None, b"d"), (0, b"c", 7, 2, u64(2), None)], []):
        q = cdc.materialise(cdc.read_changes(spark, str(log)), str(tmp_path / "state"), str(tmp_path / "cp"), "uint64_add")
        q.awaitTermination()
        frame(spark, more).write.mode("append").parquet(str(log))
        kept = sorted((tmp_path / "state" / "state").iterdir())
        states.append(collected(spark.read.parquet(str(kept[-1]))))
    assert states == [{(0, b"a"): u64(6), (0, b"b"): u64(7), (0, b"c"): u64(9)}, {(0, b"a"): u64(16), (0, b"b"): u64(7), (0, b"c"): u64(9)}, {(0, b"a"): u64(16), (0, b"c"): u64(2)}]
    assert len(kept) == 2


def test_listener_counts_batches(spark, tmp_path):
    frame(spark, [(0, b"a", 1, PUT, b"1", None)]).write.parquet(str(tmp_path / "log"))
    listener = listeners.CountingListener()
    spark.streams.addListener(listener)
    try:
        q = cdc.materialise(cdc.read_changes(spark, str(tmp_path / "log")), str(tmp_path / "state"), str(tmp_path / "cp"))
        q.awaitTermination()
        for _ in range(50):
            if listener.counts["ended"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.counts["started"] == listener.counts["ended"] == 1 and listener.rows == 1
    assert listener.table(spark).count() >= 2


def test_updates_since(spark):
    b = WriteBatch().put(b"a", b"1").put(b"b", b"2").put(b"c", b"3")
    log = b.to_log(spark, 1).unionByName(b.to_log(spark, 4))
    assert [r.seq for r in cdc.updates_since(log, 2).collect()] == [4, 5, 6]
    assert [r.seq for r in cdc.updates_since(log, 2, include_straddling=True).collect()] == [1, 2, 3, 4, 5, 6]


def test_batches():
    b = WriteBatch(has_merge_operator=False)
    with pytest.raises(Exception, match="operator"):
        b.merge(b"k", b"v")
    b.put(b"a", b"1").put_log_data(b"note")
    b.set_savepoint()
    b.delete(b"a")
    b.rollback_to_savepoint()
    with pytest.raises(InvalidInput):
        b.pop_savepoint()
    seen = []
    b.clone().append(b).iterate(lambda *o: seen.append(o))
    assert len(seen) == 2 and len(b) == 1 and b.has(PUT) and len(b.clear()) == 0


def test_user_timestamps(spark):
    rows = [(0, b"%c" % k, 10 * t + i, PUT, b"%c_%d" % (k, t), None, 0, 0, t * 100) for i, k in enumerate(b"abc") for t in (1, 2, 3)]
    rows.append((0, b"a", 99, 0, None, None, 0, 0, 200))
    from decimal import Decimal

    from versionlog.model import OPLOG

    log = spark.createDataFrame([(*r[:8], Decimal(r[8])) for r in rows], OPLOG)
    assert {bytes(r.key): bytes(r.value) for r in timetravel.as_of(log, 250).collect()} == {b"b": b"b_2", b"c": b"c_2"}
    assert {bytes(r.key) for r in timetravel.as_of(log, 150).collect()} == {b"a", b"b", b"c"}
    assert [(bytes(r.key), int(r.ts)) for r in timetravel.versions(log, 300, 200).collect()] == [(b"a", 300), (b"b", 300), (b"b", 200), (b"c", 300), (b"c", 200)]


def test_codecs(spark):
    numbers = [0, 1, 255, 1 << 32, (1 << 63) + 5, (1 << 64) - 1]
    df = spark.createDataFrame([(str(n),) for n in numbers], "n string").select(F.col("n").cast("decimal(20,0)").alias("n"))
    out = df.select("n", codecs.encode_u64le(F.col("n")).alias("le"), codecs.encode_u64ts(F.col("n")).alias("ts")).withColumn("n1", codecs.decode_u64le(F.col("le"))).withColumn("n2", codecs.decode_u64ts(F.col("ts"))).collect()
    for r in out:
        assert bytes(r.le) == int(r.n).to_bytes(8, "little") and bytes(r.ts) == ((1 << 64) - 1 - int(r.n)).to_bytes(8, "big")
        assert r.n == r.n1 == r.n2
    for columns in ({}, {b"a": b"1"}, {b"b": b"", b"a": b"x" * 300}):
        assert codecs.unpack_columns(codecs.pack_columns(columns)) == columns
    with pytest.raises(ValueError):
        codecs.unpack_columns(codecs.pack_columns({b"a": b"xyz"})[:-1])
    short = spark.createDataFrame([(b"abc",), (b"k" + b"\xff" * 8,)], "k binary")
    assert [bytes(r[0]) for r in short.select(codecs.strip_timestamp(F.col("k"))).collect()] == [b"abc", b"k"]


def test_entities(spark):
    rows = [(0, b"k", 1, {b"name": b"n", b"age": b"1"}), (0, b"k", 2, {b"age": b"2", b"city": b"c"})]
    df = spark.createDataFrame(rows, "cf_id int, key binary, seq long, columns map<binary,binary>")
    merged = wide.merge_entities(df)
    assert {bytes(k): bytes(v) for k, v in merged.first()["columns"].items()} == {b"name": b"n", b"age": b"2", b"city": b"c"}
    assert wide.project(merged, ["age", "none"]).first()["none"] is None


LOCKS = "txn_id int, cf_id int, key binary, exclusive boolean, granted boolean"


def test_locks(spark):
    locks = spark.createDataFrame([(1, 0, b"a", False, True), (2, 0, b"a", False, False), (3, 0, b"a", True, False), (1, 0, b"a", True, False)], LOCKS)
    assert [(r.waiter, r.n_holders, r.first_holder) for r in txn.lock_conflicts(locks).collect()] == [(3, 1, 1)]
    assert {tuple(r) for r in txn.waits(locks).collect()} == {(3, 1)}


def test_locks_against_all_pairs(spark):
    rng = random.Random(2)
    rows = list({(rng.randrange(12), rng.randrange(2), b"%d" % rng.randrange(4), rng.random() < 0.4, rng.random() < 0.5) for _ in range(150)})
    want = {}
    for w, cf, key, x, granted in rows:
        if not granted:
            x = any(r[3] for r in rows if r[:3] == (w, cf, key) and not r[4])
            against = {h for h, c, k, hx, g in rows if g and (c, k) == (cf, key) and h != w and (x or hx)}
            if against:
                want[w, cf, key] = (len(against), min(against))
    got = txn.lock_conflicts(spark.createDataFrame(rows, LOCKS)).collect()
    assert {(r.waiter, r.cf_id, bytes(r.key)): (r.n_holders, r.first_holder) for r in got} == want and len(got) == len(want) > 20


def test_a_dropped_family_is_gone(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    cf = s.create_cf("other")
    s.write(WriteBatch().put(b"k", b"0").put(b"k", b"1", cf=cf))
    s.drop_cf("other")
    assert collected(s.state()) == {(0, b"k"): b"0"}
    again = s.create_cf("other")
    assert again != cf and collected(s.state()) == {(0, b"k"): b"0"}
    s.write(WriteBatch().put(b"k", b"2", cf=again).delete(b"z"))
    s.compact()
    s.vacuum()
    assert s.spark.read.parquet(*s.live_files()).count() == 2


def test_files_behind_go_by_their_order(spark, tmp_path):
    file = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], "key binary, op int, value binary, end_key binary")
    s = Store(spark, str(tmp_path / "s"))
    s.write(WriteBatch().put(b"c", b"log"))
    s.ingest([file((b"a", PUT, b"zz"), (b"b", PUT, b"b1")), file((b"a", PUT, b"aa"), (b"c", PUT, b"c2"))], ingest.IngestOptions(behind=True))
    assert collected(s.state()) == {(0, b"a"): b"aa", (0, b"b"): b"b1", (0, b"c"): b"log"}


def test_one_of_two_commits_wins(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    # both see the name free; the second must not take it
    b.files.exists = lambda p: False
    a._commit(a._next(last_seq=1))
    with pytest.raises(Conflict):
        b._commit(b._next(last_seq=2))
    assert Store(spark, str(tmp_path / "s")).version.last_seq == 1 and not [n for n in a.files.names(f"{a.root}/manifest") if not n.endswith(".json")]


def test_parts_of_a_store_are_rewritten(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), merge="uint64_add")
    s.write(WriteBatch().merge(b"a", u64(1)).put(b"b", u64(2)))
    s.write(WriteBatch().put(b"a", u64(10)))
    s.write(WriteBatch().merge(b"a", u64(5)).delete(b"b"))
    s.write(WriteBatch().put(b"x", u64(7)))
    s.write(WriteBatch().delete_range(b"p", b"r"))
    want = {(0, b"a"): u64(15), (0, b"x"): u64(7)}
    assert collected(s.state()) == want
    paths = s.live_files()
    # the second folder lies between the two by seqs and goes along
    assert set(s.compact_files([paths[0], paths[2]])) == set(paths[:3])
    assert collected(s.state()) == want and len(s.live_files()) == 3
    assert s.compact(lower=b"w") == [] and s.live_files()[0] == paths[3]
    assert [f["level"] for f in s.version.folders if f["path"] == paths[3]] == [6]
    assert s.log(lower=b"x").count() == 1 and s.log(upper=b"c").count() == 1 and s.log(lower=b"q", upper=b"s").count() == 1
    with pytest.raises(NotFound):
        s.compact_files(["none"])
    s.compact()
    assert collected(s.state()) == want and len(s.live_files()) == 1
    assert s.files_table().select("num_entries", "num_deletes", "num_range_dels").collect() == [(2, 0, 0)]


def test_bounds_reach_the_files(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = spark.range(5000).select(F.lit(0).alias("cf_id"), F.encode(F.lpad(F.col("id").cast("string"), 8, "0"), "UTF-8").alias("key"), (F.col("id") + 1).alias("seq"), F.lit(PUT).cast("byte").alias("op"), F.lit(b"v").alias("value"))
    from versionlog.model import oplog

    s.append_log(oplog(rows, key=F.col("key"), seq=F.col("seq"), op=F.col("op"), value=F.col("value")))
    state = s.state(lower=b"00000100", upper=b"00000200", ranges=False)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(key" in plan and state.count() == 100
    scan = [x for x in plan.splitlines() if "ReadSchema" in x]
    assert scan and not any("batch_pos" in x or "ts:" in x for x in scan)


def test_entities_and_properties_of_a_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_entity(b"k", {b"name": b"n", b"age": b"1"})
    s.merge_entity(b"k", {b"age": b"2", b"city": b""})
    s.merge_entity(b"new", {b"a": b"b"})
    s.snapshot()
    got = {bytes(r.key): codecs.unpack_columns(bytes(r.value)) for r in s.state().collect()}
    assert got == {b"k": {b"name": b"n", b"age": b"2", b"city": b""}, b"new": {b"a": b"b"}}
    s.delete_entity(b"k")
    assert s.state().count() == 1
    assert s.property("num_entries") == 4 and s.property("n_snapshots") == 1 and s.property("live_files") == 4 and s.property("none") is None


def test_orders_and_sorted_files(spark, tmp_path):
    from versionlog.operators import scan

    s = Store(spark, str(tmp_path / "s"))
    file = spark.createDataFrame([(b"b", PUT, b"1", None), (b"A", PUT, b"2", None), (b"c", PUT, b"3", None), (b"a", PUT, b"4", None)], "key binary, op int, value binary, end_key binary")
    s.ingest([ingest.write_file(file, str(tmp_path / "f"))])
    folded = lambda k: F.lower(F.decode(k, "UTF-8"))
    keys = lambda df: [bytes(r.key) for r in df.collect()]
    assert keys(scan.scan(s.log())) == [b"A", b"a", b"b", b"c"]
    assert keys(scan.scan(s.log(), b"A", b"B", order=folded)) == [b"A", b"a"]
    assert keys(scan.scan(s.log(), order=lambda k: F.hex(k).substr(2, 1), reverse=True)) == [b"c", b"b", b"a", b"A"]
    assert keys(scan.seek(s.log(), b"B", order=folded)) == [b"b"] and keys(scan.seek_for_prev(s.log(), b"B", order=folded)) == [b"b"]
    assert keys(scan.page_after(s.log(), b"a", 1, order=folded)) == [b"b"] and keys(scan.page_after(s.log(), b"a", 1)) == [b"b"]
    with pytest.raises(InvalidInput):
        ingest.write_file(file.limit(0), str(tmp_path / "g"))


def test_values_are_verified_in_every_byte(spark):
    def value(key, ident, n):
        return key.to_bytes(8, "little") + ident.to_bytes(4, "little") + bytes((key + ident + i) % 256 for i in range(12, n))

    good = {b"k%d" % k: value(k, 7 * k, 12 + k) for k in (0, 1, 5, 300, 70_000 % 400)}
    bad = {b"k6": value(6, 1, 20)[:-1] + b"?", b"k7": value(8, 1, 20), b"k9": b"short", b"none": value(1, 1, 12)}
    df = spark.createDataFrame(list((good | bad).items()), "key binary, value binary")
    from versionlog.operators.inspect import verify_values

    assert {bytes(r.key) for r in verify_values(df).collect()} == set(bad)


def test_long_wait_cycles_are_deadlocks(spark):
    waits = [(k, (k + 1) % 20) for k in range(20)] + [(30, 0), (40, 41), (41, 40), (40, 3)]
    got = {tuple(r) for r in txn.deadlocks(spark.createDataFrame(waits, "waiter long, holder long")).collect()}
    assert got == {(k, 20) for k in range(20)} | {(40, 2), (41, 2)}


def test_pending_rows_stay_hidden(spark):
    log = frame(spark, [(0, b"a", 1, PUT, b"1", None), (0, b"a", 2, PUT, b"2", None)]).withColumn("txn_id", F.col("seq"))
    commits = spark.createDataFrame([(1, "one", "committed", 5), (2, "two", "prepared", None)], "txn_id long, name string, state string, commit_seq long")
    assert collected(resolve(txn.committed(log, commits).drop("commit_seq"))) == {(0, b"a"): b"1"}
    assert txn.committed(log, commits, 4).count() == 0
    assert [r.name for r in txn.pending(commits).collect()] == ["two"]
