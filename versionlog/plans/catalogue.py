"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.functions import codecs, keys
from versionlog.functions.codecs import decode_u64le
from versionlog.model import MERGE, PUT, RANGE_DELETE, SINGLE_DELETE, oplog, points, tombstones
from versionlog.operators import batch, compact, filters, ingest, inspect, merge, rangedel, scan, timetravel, txn, wide
from versionlog.operators.resolve import history, latest, resolve
from versionlog.sources import datasets as d
from versionlog.sources.scratch import shared_dir
from versionlog.sources.store import Backups, Store
from versionlog.streaming import cdc, listeners

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def text(c) -> F.Column:
    return F.decode(F.col(c) if isinstance(c, str) else c, "UTF-8")


def _shown(state: DataFrame) -> DataFrame:
    return state.select(text("key").alias("key"), text("value").alias("value"), "seq")


def _counted(state: DataFrame) -> DataFrame:
    return state.select(text("key").alias("key"), decode_u64le(F.col("value")).cast("long").alias("total"), "seq")


# --- SQL that several queries share

_U = "'u' || lpad(cast({} as varchar), 6, '0')"
_C = "'c' || lpad(cast({} as varchar), 8, '0')"
_OP = "case event_type when 'click' then 1 when 'error' then 0 else 2 end"
_OPR = f"case when event_type = 'signup' and event_id % 7 = 0 then 15 else {_OP} end"
_LOG = f"log as (select user_id as k, event_id + 1 as seq, {_OP} as op, cast(floor(abs(value)) as bigint) as v, event_type || '-' || event_id as t from events)"
_LOGR = f"log as (select user_id as k, event_id + 1 as seq, {_OPR} as op, cast(floor(abs(value)) as bigint) as v from events)"
_ORDERS = f"olog as (select o_custkey % 5 as cf, {_C.format('o_custkey')} as key, o_orderkey + 1 as seq, case when o_orderkey % 10 = 0 then 0 else 1 end as op, o_orderpriority || '|' || o_orderkey as v, date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as ts from orders)"
_STATE = "state as (select key, v as value, seq from (select *, row_number() over (partition by key order by seq desc) as r from olog) where r = 1 and op = 1)"


def _merged(aggregate: str, log: str = _LOG, at: str = "true") -> str:
    """Folded state by keys; rows p have k, seq, op, v, t and only those that count."""
    return f"""with {log}, vis as (select * from log where {at}),
        b as (select k, coalesce(max(case when op in (0, 1) then seq end), -1) as b from vis where op <> 15 group by k),
        c as (select b.k, coalesce(max(t.seq), -1) as c from b left join (select * from vis where op = 15) t on b.k >= t.k and b.k < t.k + 3 group by b.k),
        p as (select vis.* from vis join b using (k) join c using (k)
            where (op = 1 and seq = b and b > c) or (op = 2 and seq > b and seq > c))
        select {_U.format('k')} as key, {aggregate}, max(seq) as seq from p group by k"""


# --- versions and points


@query(f"with {_ORDERS}, {_STATE} select key, value, seq from state")
def latest_state(spark, sf):
    return _shown(latest(d.orders_log(spark, sf)))


@query(f"with {_ORDERS.replace('from orders', 'from orders where o_orderkey < (select max(o_orderkey) from orders) / 2')}, {_STATE} select key, value, seq from state")
def snapshot_read(spark, sf):
    log = d.orders_log(spark, sf)
    half = d.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] / 2
    return _shown(resolve(log, snapshot=-int(-half // 1), ranges=False))


@query(f"with {_ORDERS}, {_STATE} select key, value, seq from state where key = {_C.format(7)}")
def point_get(spark, sf):
    return _shown(scan.get(d.orders_log(spark, sf), "c00000007"))


@query(f"""with {_ORDERS}, {_STATE}, probes as (select range as pos, {_C.format('(range * 37) % 60')} as key from range(100))
    select pos, p.key, state.key is not null as found, value from probes p left join state on p.key = state.key""")
def multi_get(spark, sf):
    probes = spark.range(100).select(F.col("id").alias("pos"), d.key_of("c", F.col("id") * 37 % 60, 8).alias("key"))
    return scan.multi_get(d.orders_log(spark, sf), probes).select("pos", text("key").alias("key"), "found", text("value").alias("value"))


@query(f"with {_ORDERS}, {_STATE} select count(*) as n_exist from (select distinct {_C.format('range')} as key from range(1000)) join state using (key)")
def key_may_exist(spark, sf):
    probes = spark.range(1000).select(F.lit(0).alias("cf_id"), d.key_of("c", F.col("id"), 8).alias("key"))
    return scan.key_may_exist(d.orders_log(spark, sf), probes).agg(F.count("*").alias("n_exist"))


@query(f"with {_LOG} select {_U.format('k')} as key, seq, op, case when op <> 0 then t end as value from log")
def version_history(spark, sf):
    return history(d.texts_log(spark, sf)).select(text("key").alias("key"), "seq", F.col("op").cast("int").alias("op"), text("value").alias("value"))


@query(f"with {_ORDERS} select key, v as value, seq from (select *, row_number() over (partition by key order by seq desc) as r from olog) where r = 1 and op = 1")
def single_delete(spark, sf):
    """Single deletions hide like deletions."""
    log = d.orders_log(spark, sf)
    return _shown(resolve(log.withColumn("op", F.when(F.col("op") == 0, SINGLE_DELETE).otherwise(F.col("op")).cast("byte")), ranges=False))


@query(f"with {_LOG} select {_U.format('k')} as key, cast(sum(case when op = 0 then -v else v end) as bigint) as total from log group by k")
def merge_signed(spark, sf):
    """Signed counters: errors count down."""
    e = d.table(spark, sf, "events")
    n = F.floor(F.abs("value")).cast("decimal(20,0)")
    signed = F.when((F.col("event_type") == "error") & (n > 0), F.lit(str(1 << 64)).cast("decimal(21,0)") - n).otherwise(n)
    log = oplog(e, key=d.user_key(F.col("user_id")), seq=F.col("event_id") + 1, op=F.lit(MERGE), value=codecs.encode_u64le(signed.cast("decimal(20,0)")))
    return resolve(log, merge="signed_add", ranges=False).select(text("key").alias("key"), _signed(decode_u64le(F.col("value"))).alias("total"))


def _signed(n):
    full = F.lit(str(1 << 64)).cast("decimal(21,0)")
    return F.when(n >= F.lit(str(1 << 63)).cast("decimal(20,0)"), n - full).otherwise(n).cast("long")


@query(f"with {_ORDERS} select key, ts, seq, row_number() over (order by key desc, ts desc, seq desc) as place from olog")
def timestamp_order(spark, sf):
    """User keys backwards, of each the newest timestamp first."""
    log = d.orders_log(spark, sf)
    order = [*keys.timestamped_order(reverse=True), F.desc("seq")]
    return scan.placed(log, order).select(text("key").alias("key"), F.col("ts").cast("long").alias("ts"), "seq", "place")


# --- scans

_S = f"with {_ORDERS}, {_STATE} select key, value, seq from state "


@query(_S)
def scan_forward(spark, sf):
    return _shown(scan.scan(d.orders_log(spark, sf)))


@query(_S + "order by key desc limit 50")
def scan_reverse(spark, sf):
    return _shown(scan.scan(d.orders_log(spark, sf), reverse=True, limit=50))


@query(_S + "where key >= 'c00000020' and key < 'c00000060'")
def range_scan(spark, sf):
    return _shown(scan.scan(d.orders_log(spark, sf), "c00000020", "c00000060"))


@query(_S + "order by key limit 10")
def scan_limit(spark, sf):
    return _shown(scan.scan(d.orders_log(spark, sf), limit=10))


@query(_S + "where key > 'c00000033' order by key limit 10")
def page_after(spark, sf):
    return _shown(scan.page_after(d.orders_log(spark, sf), "c00000033", 10))


@query(_S + "where key >= 'c0000003' order by key limit 1")
def seek(spark, sf):
    return _shown(scan.seek(d.orders_log(spark, sf), "c0000003"))


@query(_S + "where key <= 'c0000003' order by key desc limit 1")
def seek_for_prev(spark, sf):
    return _shown(scan.seek_for_prev(d.orders_log(spark, sf), "c0000003"))


@query("select source || ':' || lpad(cast(doc_id as varchar), 8, '0') as key, lang as value, doc_id + 1 as seq from documents where source like 'src3%' and source || ':' >= 'src3:'")
def prefix_scan(spark, sf):
    return _shown(scan.prefix_scan(d.sources_log(spark, sf), "src3:", keys.fixed(4)))


@query(f"with {_ORDERS}, {_STATE} select key, lag(key) over (order by key) as prev_key, lead(key) over (order by key) as next_key from state")
def neighbours(spark, sf):
    found = scan.neighbours(latest(d.orders_log(spark, sf)))
    return found.select(text("key").alias("key"), text("prev_key").alias("prev_key"), text("next_key").alias("next_key"))


@query(f"with {_ORDERS} select cf as cf_id, count(distinct key) as n_keys from olog group by cf")
def merged_runs(spark, sf):
    log = d.orders_log(spark, sf, by_nation=True)
    runs = [log.where(F.col("seq") % 3 == k) for k in range(3)]
    return scan.merged_runs(*runs).groupBy("cf_id").agg(F.count_distinct("key").alias("n_keys"))


# --- merges


@query(_merged("cast(sum(v) as bigint) as total"))
def merge_counter(spark, sf):
    return _counted(resolve(d.events_log(spark, sf), merge="uint64_add", ranges=False))


@query(f"""with {_LOG} select {_U.format('k')} as key, cast(sum(cast(v + 9223372036854775000 as hugeint)) % 18446744073709551616 as varchar) as total, max(seq) as seq from log group by k""")
def merge_counter_wrap(spark, sf):
    e = d.table(spark, sf, "events")
    # a value above 807 passes the signed range here
    near_half = F.floor(F.abs("value")).cast("decimal(20,0)") + F.lit("9223372036854775000").cast("decimal(20,0)")
    log = oplog(e, key=d.user_key(F.col("user_id")), seq=F.col("event_id") + 1, op=F.lit(MERGE), value=codecs.encode_u64le(near_half))
    state = resolve(log, merge="uint64_add", ranges=False)
    return state.select(text("key").alias("key"), decode_u64le(F.col("value")).cast("string").alias("total"), "seq")


@query(_merged("string_agg(t, ',' order by seq) as value"))
def merge_append(spark, sf):
    return _shown(resolve(d.texts_log(spark, sf), merge="string_append", ranges=False))


@query(_merged("max(t) as value"))
def merge_max(spark, sf):
    return _shown(resolve(d.texts_log(spark, sf), merge="max", ranges=False))


@query(_merged("string_agg(t, '/' order by seq) as value"))
def merge_associative(spark, sf):
    joined = merge.associative("slashes", lambda a, b: F.concat(a, F.lit(b"/"), b))
    return _shown(resolve(d.texts_log(spark, sf), merge=joined, ranges=False))


@query(_merged("max(case when op = 1 then t else '' end) || '+' || count(*) filter (where op = 2) as value").replace("p as (select vis.*", "q as (select vis.*").replace("select 'u'", ", p as (select * from q where k in (select k from q where op = 2) or op = 1) select 'u'", 1).replace("max(case when op = 1 then t else '' end) || '+' || count(*) filter (where op = 2) as value", "case when count(*) filter (where op = 2) = 0 then max(t) else max(case when op = 1 then t else '' end) || '+' || count(*) filter (where op = 2) end as value"))
def merge_custom(spark, sf):
    def full(key, base, operands):
        return (base or b"") + b"+" + str(len(operands)).encode()

    return _shown(resolve(d.texts_log(spark, sf), merge=merge.custom("count", full), ranges=False))


@query(f"""with {_LOG}, b as (select k, max(seq) as b from log where op = 0 group by k)
    select {_U.format('log.k')} as key, cast(sum(v) as bigint) as total from log join b using (k) where op = 2 and seq > b and k not in (select log.k from log join b using (k) where op = 1 and seq > b) group by log.k""")
def merge_after_delete(spark, sf):
    """Operands above a deletion fold over nothing."""
    log = d.events_log(spark, sf)
    last = points(log).where("op in (0, 1)").groupBy("key").agg(F.max(F.struct("seq", "op")).alias("b")).where("b.op = 0").select("key")
    state = resolve(log, merge="uint64_add", ranges=False).join(last, "key")
    return state.select(text("key").alias("key"), decode_u64le(F.col("value")).cast("long").alias("total"))


@query(f"with {_LOG} select {_U.format('k')} as key, true as failed from log where op = 2 group by k")
def merge_failure(spark, sf):
    """Operands of a wrong length fail; here they give null."""
    log = d.texts_log(spark, sf).where("op = 2")
    state = resolve(log, merge="uint64_add", on_error="null", ranges=False)
    return state.select(text("key").alias("key"), F.col("value").isNull().alias("failed"))


# --- range deletions


@query(_merged("cast(sum(v) as bigint) as total", _LOGR))
def range_delete(spark, sf):
    return _counted(resolve(d.events_log(spark, sf, ranges=True), merge="uint64_add"))


@query(_merged("cast(sum(v) as bigint) as total", _LOGR, "seq <= 400"))
def range_delete_snapshot(spark, sf):
    return _counted(resolve(d.events_log(spark, sf, ranges=True), 400, "uint64_add"))


_TOMBS = f"{_LOGR}, tb as (select k as lo, k + 3 as hi, seq from log where op = 15)"


@query(f"""with {_TOMBS}, bd as (select lo as x from tb union select hi from tb), fr as (select x as lo, lead(x) over (order by x) as hi from bd)
    select {_U.format('fr.lo')} as start_key, {_U.format('fr.hi')} as end_key, max(seq) as seq from fr join tb on tb.lo <= fr.lo and tb.hi >= fr.hi group by all""")
def tombstone_fragments(spark, sf):
    cut = rangedel.fragments(tombstones(d.events_log(spark, sf, ranges=True)))
    return cut.select(text("start_key").alias("start_key"), text("end_key").alias("end_key"), "seq")


@query(f"""with {_TOMBS}, ks as (select distinct k from log where op <> 15)
    select {_U.format('k')} as key, coalesce(max(tb.seq), 0) as cover_seq from ks left join tb on k >= lo and k < hi group by k""")
def max_cover_seq(spark, sf):
    log = d.events_log(spark, sf, ranges=True)
    return rangedel.max_cover_seq(points(log), tombstones(log)).select(text("key").alias("key"), "cover_seq")


@query(f"""with {_TOMBS}, ks as (select distinct k from log where op <> 15)
    select {_U.format('k')} as key, max(tb.seq) as cover_seq from ks join tb on k >= lo and k < hi group by k""")
def cover_by_fragments(spark, sf):
    log = d.events_log(spark, sf, ranges=True)
    return rangedel.cover(points(log), tombstones(log), method="sweep").select(text("key").alias("key"), "cover_seq")


# --- time

_ASOF = f"with {_ORDERS}, seen as (select *, row_number() over (partition by key order by ts desc, seq desc) as r from olog where ts <= 2000)"


@query(_ASOF + " select key, v as value, ts from seen where r = 1 and op = 1")
def asof_timestamp(spark, sf):
    return timetravel.as_of(d.orders_log(spark, sf), 2000).select(text("key").alias("key"), text("value").alias("value"), F.col("ts").cast("long").alias("ts"))


def _versions_sql(since: str) -> str:
    return f"""with {_ORDERS}, seen as (select * from olog where ts <= 2000), gone as (select key, max(ts) as g from seen where op = 0 group by key),
        cells as (select key, ts, arg_max(v, seq) as value from seen where op = 1 group by key, ts)
        select cells.key, ts, value from cells left join gone using (key) where (g is null or ts > g) {since}"""


@query(_versions_sql(""))
def timestamp_versions(spark, sf):
    return timetravel.versions(d.orders_log(spark, sf), 2000).select(text("key").alias("key"), F.col("ts").cast("long").alias("ts"), text("value").alias("value"))


@query(_versions_sql("and ts >= 1500"))
def timestamp_window(spark, sf):
    return timetravel.versions(d.orders_log(spark, sf), 2000, 1500).select(text("key").alias("key"), F.col("ts").cast("long").alias("ts"), text("value").alias("value"))


_TTL = "select event_id, cast(floor(epoch(ts)) as bigint) as created_at from events"


def _stamped(spark, sf):
    e = d.table(spark, sf, "events")
    return e.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"))


def _middle(spark, sf) -> int:
    return d.table(spark, sf, "events").agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp")))).first()[0]


@query(f"select * from ({_TTL}) where not ((select cast(floor(max(epoch(ts))) as bigint) from events) > created_at + 864000)")
def ttl_visible(spark, sf):
    return timetravel.alive(_stamped(spark, sf), 864000, _middle(spark, sf))


@query(f"select * from ({_TTL}) where (select cast(floor(max(epoch(ts))) as bigint) from events) > created_at + 864000")
def ttl_expired(spark, sf):
    return _stamped(spark, sf).where(timetravel.expired(F.col("created_at"), 864000, _middle(spark, sf)))


@query(f"select event_id from ({_TTL}) where not ((select cast(floor(max(epoch(ts))) as bigint) from events) > created_at + 864000)")
def ttl_values(spark, sf):
    rows = _stamped(spark, sf).withColumn("value", codecs.append_expiry_base(F.encode(F.col("event_id").cast("string"), "UTF-8"), F.col("created_at")))
    return timetravel.alive_values(rows, 864000, _middle(spark, sf)).select(text("value").cast("long").alias("event_id"))


# --- wide columns

_WIDE = f"w as (select {_C.format('c_custkey')} as key, c_name as name, c_mktsegment as segment from customer)"
_LASTO = f"lo as (select {_C.format('o_custkey')} as key, arg_max(o_orderpriority, o_orderkey) as last_priority, arg_max(o_orderstatus, o_orderkey) as last_status from orders group by o_custkey)"


@query(f"with {_WIDE}, {_LASTO} select key, name, segment, last_priority, last_status from w full join lo using (key)")
def entity_merge(spark, sf):
    merged = wide.merge_entities(d.customers(spark, sf).unionByName(d.order_entities(spark, sf)))
    shown = wide.project(merged, ["name", "segment", "last_priority", "last_status"])
    return shown.select(text("key").alias("key"), *[text(c).alias(c) for c in ("name", "segment", "last_priority", "last_status")])


@query(f"with {_WIDE} select key, segment from w where key = {_C.format(5)}")
def entity_get(spark, sf):
    one = d.customers(spark, sf).where(F.col("key") == F.lit(b"c00000005"))
    return one.select(text("key").alias("key"), text(wide.column(F.col("columns"), "segment")).alias("segment"))


@query(f"with {_WIDE} select key, segment, cast(null as varchar) as missing from w")
def entity_project(spark, sf):
    return wide.project(d.customers(spark, sf), ["segment", "missing"]).select(text("key").alias("key"), text("segment").alias("segment"), text("missing").alias("missing"))


@query(f"with {_WIDE} select key, 'name' as first_column, name as first_value, 2 as n_columns from w")
def entity_codec(spark, sf):
    packed = d.customers(spark, sf).select("key", codecs.encode_wide(F.col("columns")).alias("raw"))
    back = packed.select("key", wide.by_name(codecs.decode_wide(F.col("raw"))).alias("e"))
    return back.select(text("key").alias("key"), text(F.col("e")[0]["key"]).alias("first_column"), text(F.col("e")[0]["value"]).alias("first_value"), F.size("e").alias("n_columns"))


# --- batches, column families, transactions


@query(f"""with {_LOG} select seq - (seq - 1) % 10 as batch_seq, count(*) as n_ops, count(*) filter (where op = 1) as n_puts, count(*) filter (where op = 0) as n_deletes,
    count(*) filter (where op = 2) as n_merges, max(seq) as last_seq from log group by all""")
def batch_atomic(spark, sf):
    return batch.batch_summary(d.events_log(spark, sf)).select("batch_seq", "n_ops", "n_puts", "n_deletes", "n_merges", "last_seq")


@query(f"with {_ORDERS}, s as (select *, row_number() over (partition by cf, key order by seq desc) as r from olog) select cf as cf_id, count(*) as n_keys, max(seq) as last_seq from s where r = 1 and op = 1 group by cf")
def cf_isolation(spark, sf):
    return latest(d.orders_log(spark, sf, by_nation=True)).groupBy("cf_id").agg(F.count("*").alias("n_keys"), F.max("seq").alias("last_seq"))


@query(f"with {_ORDERS}, s as (select *, row_number() over (partition by cf, key order by seq desc) as r from olog) select cf as cf_id, key from s where r = 1 and op = 1 and cf in (1, 3)")
def multi_cf_scan(spark, sf):
    return scan.scan(d.orders_log(spark, sf, by_nation=True), cfs=(1, 3)).select("cf_id", text("key").alias("key"))


@query(f"""with {_ORDERS}, tr as (select o_orderkey as txn_id, {_C.format('o_custkey')} as key, o_orderkey + 1 as seq from orders),
    last as (select key, max(seq) as last from olog group by key),
    hit as (select txn_id, count(*) as n from (select distinct tr.txn_id, tr.key from tr join last using (key) where last > tr.seq) group by txn_id)
    select distinct tr.txn_id, n is null as commits, coalesce(n, 0) as n_conflicts from tr left join hit using (txn_id)""")
def optimistic_conflicts(spark, sf):
    log = d.orders_log(spark, sf)
    tracked = log.select((F.col("seq") - 1).alias("txn_id"), "cf_id", "key", "seq")
    return txn.validate(tracked, log, tracked.select("txn_id").distinct())


@query("""select 'c' || lpad(cast(o_custkey as varchar), 8, '0') as key, max(o_orderkey + 1) as seq from orders where o_orderkey % 4 < 2 and o_orderkey + 5 <= 1000 group by o_custkey""")
def prepared_visibility(spark, sf):
    """Of four transactions two commit; a snapshot sees those that committed by then."""
    log = d.orders_log(spark, sf).withColumn("op", F.lit(PUT).cast("byte"))
    prepared = log.withColumn("txn_id", F.col("seq") - 1)
    state = F.when(F.col("txn_id") % 4 < 2, "committed").when(F.col("txn_id") % 4 == 2, "prepared").otherwise("rolled_back")
    commits = prepared.select("txn_id", state.alias("state"), (F.col("txn_id") + 5).alias("commit_seq"))
    return latest(txn.committed(prepared, commits, 1000).drop("commit_seq")).select(text("key").alias("key"), "seq")


@query("select o_orderkey as txn_id, 'order-' || o_orderkey as name from orders where o_orderkey % 4 = 2")
def pending_transactions(spark, sf):
    o = d.table(spark, sf, "orders")
    state = F.when(F.col("o_orderkey") % 4 < 2, "committed").when(F.col("o_orderkey") % 4 == 2, "prepared").otherwise("rolled_back")
    return txn.pending(o.select(F.col("o_orderkey").alias("txn_id"), state.alias("state"), F.concat(F.lit("order-"), "o_orderkey").alias("name")))


@query("select 'a' as key, '1' as value union all select 'd', '4'")
def savepoint_rollback(spark, sf):
    b = batch.WriteBatch().put(b"a", b"1")
    b.set_savepoint()
    b.put(b"b", b"2").delete(b"a")
    b.rollback_to_savepoint()
    b.put(b"d", b"4")
    return latest(b.to_log(spark, 1)).select(text("key").alias("key"), text("value").alias("value"))


_LOCKS = "locks as (select o_orderkey as txn_id, o_custkey as key, o_orderkey % 3 = 0 as x, o_orderkey % 2 = 0 as granted from orders)"


@query(f"""with {_LOCKS}, h as (select key, count(*) as n, count(*) filter (where x) as nx, min(txn_id) as a, min(txn_id) filter (where x) as ax from locks where granted group by key),
    w as (select locks.txn_id as waiter, key, case when x then n else nx end as n_holders, case when x then a else ax end as first_holder from locks join h using (key) where not granted)
    select waiter, 0 as cf_id, key, n_holders, first_holder from w where n_holders > 0""")
def lock_conflicts(spark, sf):
    o = d.table(spark, sf, "orders")
    locks = o.select(F.col("o_orderkey").alias("txn_id"), F.lit(0).alias("cf_id"), F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 3 == 0).alias("exclusive"), (F.col("o_orderkey") % 2 == 0).alias("granted"))
    return txn.lock_conflicts(locks)


#: Orders wait in groups of six: the first 2 to 6 of a group in a circle, the others for the first.
_WAITS = """waits as (select o_orderkey as waiter, o_orderkey - o_orderkey % 6 + case when o_orderkey % 6 < 2 + (o_orderkey // 6) % 5 then (o_orderkey % 6 + 1) % (2 + (o_orderkey // 6) % 5) else 0 end as holder from orders)"""


@query(f"""with recursive {_WAITS}, r(origin, place, length) as (select waiter, holder, 1 from waits union all select origin, holder, length + 1 from r join waits on waiter = place where place <> origin and length < 7)
    select origin as txn_id, cast(min(length) as int) as length from r where place = origin group by origin""")
def deadlocks(spark, sf):
    k = F.col("o_orderkey")
    circle = F.lit(2) + F.floor(k / 6) % 5
    holder = k - k % 6 + F.when(k % 6 < circle, (k % 6 + 1) % circle).otherwise(0)
    return txn.deadlocks(d.table(spark, sf, "orders").select(k.alias("waiter"), holder.cast("long").alias("holder")))


# --- filters and compaction


@query(_S + "where key not like 'c0000001%'")
def filter_prefix(spark, sf):
    return _shown(filters.apply(latest(d.orders_log(spark, sf)), filters.remove_by_prefix("c0000001")))


@query(_S + "where not (key >= 'c00000020' and key < 'c00000040')")
def filter_range(spark, sf):
    return _shown(filters.apply(latest(d.orders_log(spark, sf)), filters.remove_by_range(b"c00000020", b"c00000040")))


@query(f"with {_ORDERS}, {_STATE} select key, case when value like '1-URGENT%' then 'urgent' else value end as value, seq from state")
def filter_change(spark, sf):
    change = filters.change_value("urgent", lambda k, v: F.startswith(v, F.lit(b"1-URGENT")), lambda k, v: F.lit(b"urgent"))
    return _shown(filters.apply(latest(d.orders_log(spark, sf)), change))


@query(_merged("cast(sum(v) as bigint) as total", _LOG.replace("from events", "from events where not (event_type not in ('click', 'error') and floor(abs(value)) % 2 = 1)")))
def filter_operand(spark, sf):
    even = filters.CompactionFilter("even", lambda k, v: F.lit(filters.KEEP), keep_operand=lambda k, v: decode_u64le(v) % 2 == 0)
    return _counted(resolve(filters.filter_operands(d.events_log(spark, sf), even), merge="uint64_add", ranges=False))


@query(_merged("cast(sum(v) as bigint) as total", _LOGR))
def compact_state(spark, sf):
    return _counted(resolve(compact.compact(d.events_log(spark, sf, ranges=True), merge="uint64_add", full=True), merge="uint64_add"))


@query(_merged("cast(sum(v) as bigint) as total", _LOGR, "seq <= 400"))
def compact_keeps_snapshots(spark, sf):
    small = compact.compact(d.events_log(spark, sf, ranges=True), snapshots=(200, 400, 700), merge="uint64_add")
    return _counted(resolve(small, 400, "uint64_add"))


@query(_merged("cast(sum(v) as bigint) as total").replace("select 'u'", "select * from (select 'u'").replace("from p group by k", "from p group by k) where key not like 'u00000%'"))
def filter_in_rewrite(spark, sf):
    """A rewrite of the whole log that drops the keys of a prefix after the fold."""
    log = d.events_log(spark, sf)
    return _counted(resolve(compact.compact(log, merge="uint64_add", filter_=filters.remove_by_prefix("u00000"), full=True), merge="uint64_add", ranges=False))


@query(f"select event_id, created_at from ({_TTL}) where not ((select cast(floor(max(epoch(ts))) as bigint) from events) > created_at + 864000)")
def filter_expired(spark, sf):
    """A rewrite that drops expired values."""
    rows = _stamped(spark, sf)
    value = codecs.append_expiry_base(F.encode(F.col("event_id").cast("string"), "UTF-8"), F.col("created_at"))
    log = oplog(rows, key=d.key_of("e", F.col("event_id"), 9), seq=F.col("event_id") + 1, op=F.lit(PUT), value=value)
    left = latest(compact.compact(log, filter_=compact.factory(lambda context: filters.remove_expired(864000, _middle(spark, sf))), full=True))
    return left.select(text(codecs.strip_expiry_base(F.col("value"))).cast("long").alias("event_id"), codecs.created_at_of(F.col("value")).alias("created_at"))


def _store(spark, sf) -> Store:
    """Orders in a store: commits of puts by thirds of the customers, then one of deletions of all, and one apart."""
    store = Store(spark, shared_dir(spark, "store"))
    log, top = d.orders_log(spark, sf), d.table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    third = F.least(F.floor(F.substring(text("key"), 2, 8).cast("long") * 3 / (top + 1)), F.lit(2))
    for k in range(3):
        store.append_log(log.where((F.col("op") == PUT) & (third == k)))
    store.append_log(log.where(F.col("op") != PUT))
    apart = d.table(spark, sf, "nation")
    store.append_log(oplog(apart, key=d.key_of("n", F.col("n_nationkey"), 8), seq=F.col("n_nationkey") + (1 << 40), op=F.lit(PUT), value=F.encode("n_name", "UTF-8")))
    return store


_NATIONS = f"nations as (select 'n' || lpad(cast(n_nationkey as varchar), 8, '0') as key, n_name as value, n_nationkey + 1099511627776 as seq from nation)"
_STORED = f"with {_ORDERS}, {_STATE}, {_NATIONS}, every as (select key, value, seq from state union all select * from nations)"


@query(_STORED + " select key, value, seq from every")
def compact_files(spark, sf):
    """Two folders are rewritten into one, the others stay; the state is as before."""
    store = _store(spark, sf)
    paths = store.live_files()
    store.compact_files([paths[0], paths[3]])
    assert len(store.live_files()) < len(paths)
    return _shown(store.state())


@query(_STORED + " select key, value, seq from every")
def compact_range(spark, sf):
    """Only folders that may hold the keys are rewritten."""
    store = _store(spark, sf)
    kept = store.live_files()[4]
    store.compact(lower=b"c00000010", upper=b"c00000020")
    assert kept in store.live_files()
    return _shown(store.state())


@query(_STORED + " select key, value, seq from every where key >= 'n'")
def trivial_move(spark, sf):
    """A folder that nothing overlaps changes its level and is not rewritten; a read with bounds takes no other."""
    store = _store(spark, sf)
    paths = store.live_files()
    store.compact(lower=b"n")
    assert store.live_files() == paths and store.version.folders[4]["level"] == compact.LEVELS - 1
    return _shown(store.state(lower=b"n"))


@query(f"""with {_ORDERS}, l as (select case when op = 0 then 3 else least(cast(substr(key, 2) as bigint) * 3 // ((select max(c_custkey) from customer) + 1), 2) end as file_number, * from olog where cf = cf)
    select file_number, 0 as level, count(*) as num_entries, count(*) filter (where op = 0) as num_deletes, min(key) as smallest, max(key) as largest, min(seq) as smallest_seq, max(seq) as largest_seq,
    cast(sum(length(key) + case when op = 1 then length(v) else 0 end) as bigint) as size from l group by all
    union all select 4, 0, count(*), 0, min('n' || lpad(cast(n_nationkey as varchar), 8, '0')), max('n' || lpad(cast(n_nationkey as varchar), 8, '0')), min(n_nationkey) + 1099511627776, max(n_nationkey) + 1099511627776, cast(sum(9 + length(n_name)) as bigint) from nation""")
def live_files(spark, sf):
    """Files, key ranges and counts come from the manifest."""
    f = _store(spark, sf).files_table()
    return f.select("file_number", "level", "num_entries", "num_deletes", text("smallest").alias("smallest"), text("largest").alias("largest"), "smallest_seq", "largest_seq", "size")


@query(_STORED + " select key, value, seq from every")
def checkpoint_state(spark, sf):
    """A checkpoint reads like its store, whatever is written after it."""
    store = _store(spark, sf)
    copy = store.checkpoint(shared_dir(spark, "copy"))
    store.write(batch.WriteBatch().delete_range(b"a", b"z"))
    return _shown(copy.state())


@query("select unnest([2, 3]) as backup, (select count(*) from nation) as n_keys")
def backup_purge(spark, sf):
    """Of three backups the newest two stay and can be restored."""
    store = Store(spark, shared_dir(spark, "store"))
    apart = d.table(spark, sf, "nation")
    store.append_log(oplog(apart, key=d.key_of("n", F.col("n_nationkey"), 8), seq=F.col("n_nationkey") + 1, op=F.lit(PUT), value=F.encode("n_name", "UTF-8")))
    backups = Backups(spark, shared_dir(spark, "backups"))
    for _ in range(3):
        backups.create(store)
    backups.purge(2)
    restored = [(k, backups.restore(k, shared_dir(spark, "restored")).state()) for k in backups.list()]
    counted = [s.agg(F.count("*").alias("n_keys")).select(F.lit(k).alias("backup"), "n_keys") for k, s in restored]
    return counted[0].unionByName(counted[1])


@query(f"with {_ORDERS} select key, v as value, seq from (select *, row_number() over (partition by cf, key order by seq desc) as r from olog) where r = 1 and op = 1 and cf <> 3")
def cf_dropped(spark, sf):
    """Rows of a column family that was dropped are gone, for reads and rewrites."""
    store = Store(spark, shared_dir(spark, "store"))
    for k in range(1, 5):
        store.create_cf(f"cf{k}")
    store.append_log(d.orders_log(spark, sf, by_nation=True))
    store.drop_cf("cf3")
    before = store.state().count()
    store.compact()
    assert store.state().count() == before
    return _shown(store.state())


@query(f"""with {_ORDERS}, {_STATE}, tb as (select {_C.format('o_custkey')} as lo, {_C.format('o_custkey + 2')} as hi, o_orderkey * 3 % (select max(o_orderkey) from orders) as seq from orders),
    c as (select state.key, max(tb.seq) as c from state join tb on state.key >= lo and state.key < hi group by state.key)
    select key, value, state.seq from state left join c using (key) where c is null or state.seq >= c""")
def range_delete_many(spark, sf):
    """As many range deletions as orders: they are swept along with the keys."""
    o, log = d.table(spark, sf, "orders"), d.orders_log(spark, sf)
    top = o.agg(F.max("o_orderkey")).first()[0]
    t = oplog(o, key=d.key_of("c", F.col("o_custkey"), 8), seq=F.col("o_orderkey") * 3 % top, op=F.lit(RANGE_DELETE), value=F.lit(None), end_key=d.key_of("c", F.col("o_custkey") + 2, 8))
    return _shown(resolve(log.unionByName(t)))


_FILES = """files as (select event_id // 250 as file_number, cast((event_id // 250) % 4 as int) as level, cast(sum(length(props)) * 1000 as bigint) as size, min(user_id) as lo, max(user_id) as hi,
    1000000 + (event_id // 250) * 60 as created_at, count(*) as n from events group by event_id // 250)"""


@query(f"""with {_FILES}, l as (select level, count(*) as n_files, cast(sum(size) as bigint) as bytes from files group by level),
    s as (select *, case when level = 0 then n_files / cast(4 as double) when level < 6 then bytes / (cast(20000 as double) * pow(cast(10 as double), level - 1)) else cast(0 as double) end as score from l),
    r as (select *, row_number() over (order by score desc, level) = 1 and score >= 1 as picked from s)
    select level, n_files, bytes, score, picked, case when picked and level > 0 then (select arg_max(file_number, size * 100000 - file_number) from files f where f.level = r.level) end as picked_file from r""")
def compaction_pick_leveled(spark, sf):
    return compact.pick_leveled(d.files(spark, sf), base_bytes=20000)


@query(f"""with {_FILES}, k as (select *, sum(size) over (order by created_at desc, file_number desc) as kept from files)
    select file_number, size, created_at, cast(kept as bigint) as kept_bytes, kept > 5000000 as drop from k""")
def compaction_pick_fifo(spark, sf):
    return compact.pick_fifo(d.files(spark, sf), now=0, max_bytes=5_000_000)


@query()
def compaction_pick_universal(spark, sf):
    runs = compact.pick_universal(d.files(spark, sf))
    return spark.createDataFrame([(k, r) for k, r in enumerate(runs)], "place int, run long")


@query(f"with {_FILES} select file_number, size, created_at from files where level = 0 and (select count(*) from files where level = 0) >= 4 order by created_at limit 10")
def compaction_intra_l0(spark, sf):
    return compact.intra_l0(d.files(spark, sf))


@query(f"with {_FILES} select file_number, case when n > 3 or file_number >= 36 then 'stop' when file_number >= 20 then 'delay' else 'none' end as stall from (select file_number, n % 5 as n from files)")
def stall_rule(spark, sf):
    f = d.files(spark, sf)
    return f.select("file_number", compact.stall(F.col("num_entries") % 5, 4, F.col("file_number")).alias("stall"))


# --- inspection


@query(f"with {_FILES} select level, count(*) as n_files, cast(sum(size) as bigint) as bytes from files group by level")
def level_stats(spark, sf):
    return inspect.level_stats(d.files(spark, sf))


@query(f"""with {_ORDERS} select cf as cf_id, count(*) as entries, cast(sum(length(key)) as bigint) as key_bytes, cast(sum(case when op = 1 then length(v) else 0 end) as bigint) as value_bytes, avg(length(key)) as avg_key, avg(case when op = 1 then length(v) else 0 end) as avg_value,
    min(key) as smallest, max(key) as largest from olog group by cf""")
def file_properties(spark, sf):
    stats = inspect.table_stats(d.orders_log(spark, sf, by_nation=True), ["cf_id"])
    return stats.select("cf_id", "entries", "key_bytes", "value_bytes", "avg_key", "avg_value", text("smallest").alias("smallest"), text("largest").alias("largest"))


@query(f"""with {_LOGR} select count(*) as num_entries, count(*) filter (where op = 0) as num_deletes, count(*) filter (where op = 2) as num_merges,
    count(*) filter (where op = 15) as num_range_dels, min(seq) as smallest_seq, max(seq) as largest_seq,
    7 * count(*) as raw_key_bytes, 8 * count(*) filter (where op in (1, 2)) as raw_value_bytes from log""")
def entry_stats(spark, sf):
    return inspect.entry_stats(d.events_log(spark, sf, ranges=True))


@query(f"""with {_FILES}, r as (select range as range_id, range * 5 as a, range * 5 + 3 as b from range(8))
    select range_id, coalesce(cast(sum(size) as bigint), 0) as bytes, count(size) as n_files from r left join files on lo < b and hi >= a group by range_id""")
def approx_sizes(spark, sf):
    ranges = spark.range(8).select(F.col("id").alias("range_id"), d.user_key(F.col("id") * 5).alias("start_key"), d.user_key(F.col("id") * 5 + 3).alias("end_key"))
    return inspect.approximate_sizes(d.files(spark, sf), ranges)


@query(f"with {_FILES} select cast(sum(size // 100) as bigint) as estimated_keys from files")
def estimate_keys(spark, sf):
    return inspect.estimate_keys(d.files(spark, sf))


@query("""select k as seq, count(distinct v) as n_values, count(*) as n_rows from (select l_orderkey as k, l_linenumber as n, l_quantity as v from lineitem) group by k, n having count(distinct v) > 1""")
def collision_check(spark, sf):
    li = d.table(spark, sf, "lineitem")
    log = oplog(li, key=F.encode(F.col("l_linenumber").cast("string"), "UTF-8"), seq=F.col("l_orderkey"), op=F.lit(PUT), value=F.encode(F.col("l_quantity").cast("string"), "UTF-8"))
    return inspect.collisions(log).select("seq", "n_values", "n_rows")


_TRACE = "tr as (select event_id * 1000000 as ts_ns, case event_type when 'click' then 'put' when 'error' then 'delete' when 'purchase' then 'merge' when 'view' then 'get' else 'new_iterator' end as type from events)"


@query(f"""with {_TRACE} select type, count(*) as n, (select count(*) from tr) as total, (select max(ts_ns) - min(ts_ns) from tr) as span_ns,
    (select count(*) * cast(1000000000 as double) / (max(ts_ns) - min(ts_ns)) from tr) as per_second from tr group by type""")
def trace_stats(spark, sf):
    return inspect.trace_stats(d.trace(spark, sf))


@query(f"with {_TRACE} select type, case when type in ('put', 'delete', 'merge') then 'applied' when type = 'get' then 'read' else 'skipped' end as outcome, count(*) as n from tr group by type")
def trace_replay_counts(spark, sf):
    return cdc.replay_counts(d.trace(spark, sf))


@query(_merged("cast(sum(v) as bigint) as total", _LOG.replace("from events", "from events where event_type in ('click', 'error', 'purchase')")))
def trace_replay(spark, sf):
    return _counted(resolve(cdc.replay(d.trace(spark, sf)), merge="uint64_add", ranges=False))


@query(f"""with {_ORDERS}, {_STATE}, x as (select row_number() over (order by key) - 1 as place, list_reduce(list_transform(string_split(key || value, ''), lambda c: cast(ascii(c) as bigint)), lambda a, b: xor(a, b)) as x from state)
    select count(*) as n_keys, coalesce(bit_xor(x << cast((place % 8) * 8 as int)), 0) as digest from x""")
def state_digest(spark, sf):
    return inspect.state_digest(latest(d.orders_log(spark, sf)))


@query("""select event_type as metric, count(*) as n, round(sum(value), 4) as total, min(value) as least, max(value) as most, round(avg(value), 6) as average,
    quantile_disc(value, 0.5) as median, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, round(stddev_pop(value), 6) as deviation from events group by event_type""")
def histogram_stats(spark, sf):
    return inspect.histogram(d.table(spark, sf, "events").withColumnRenamed("event_type", "metric"), "metric", "value").select("metric", "n", F.round("total", 4).alias("total"), "least", "most", F.round("average", 6).alias("average"), "median", "p95", "p99", F.round("deviation", 6).alias("deviation"))


@query("""with m as (select user_id as ticker, event_id as seq, case when event_type = 'error' then 'set' else 'add' end as action, cast(floor(abs(value)) as bigint) as n from events),
    s as (select ticker, max(seq) as s, arg_max(n, seq) as n0 from m where action = 'set' group by ticker)
    select m.ticker, cast(coalesce(max(n0), 0) + sum(case when action = 'add' and (s is null or seq > s) then n else 0 end) as bigint) as value from m left join s using (ticker) group by m.ticker""")
def ticker_counters(spark, sf):
    e = d.table(spark, sf, "events")
    return inspect.tickers(e.select(F.col("user_id").alias("ticker"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "set").otherwise("add").alias("action"), F.floor(F.abs("value")).alias("n")))


@query("select count(*) as n_snapshots, coalesce(arg_min(user_id * 7, event_id), 0) as oldest_time from events")
def snapshot_stats(spark, sf):
    e = d.table(spark, sf, "events")
    return inspect.snapshot_stats(e.select(F.col("event_id").alias("seq"), (F.col("user_id") * 7).alias("created_at")))


@query(f"""with {_LOGR}, {_FILES} select 'num_entries' as name, count(*) as value from log union all select 'num_deletes', count(*) from log where op = 0 union all select 'num_merges', count(*) from log where op = 2
    union all select 'num_range_dels', count(*) from log where op = 15 union all select 'largest_seq', max(seq) from log union all select 'live_files', count(*) from files
    union all select 'total_file_bytes', cast(sum(size) as bigint) from files union all select 'estimate_num_keys', cast(sum(size // 100) as bigint) from files
    union all select 'num_files_at_level' || range, (select count(*) from files where level = range) from range(7)""")
def properties(spark, sf):
    return inspect.properties(d.events_log(spark, sf, ranges=True), d.files(spark, sf))


@query("""select event_type as kind, count(*) as n, count(*) filter (where user_id % 5 = 0) as n_failed, cast(sum(user_id % 13) as bigint) as total_time, max(user_id % 13) as longest from events group by event_type""")
def listener_counts(spark, sf):
    e = d.table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("kind"), F.col("event_id").alias("started_at"), (F.col("event_id") + F.col("user_id") % 13).alias("ended_at"), (F.col("user_id") % 5 == 0).alias("failed"))
    return listeners.event_counts(rows)


# --- loading and feeds


def _loaded(spark, sf):
    l = d.table(spark, sf, "labels")
    return l.groupBy("doc_id").agg(F.max("quality").alias("q")).select(F.encode(F.lpad(F.col("doc_id").cast("string"), 8, "0"), "UTF-8").alias("key"), F.lit(PUT).alias("op"), F.encode(F.concat(F.lit("q"), F.col("q")), "UTF-8").alias("value"), F.lit(None).cast("binary").alias("end_key"))


def _docs_log(spark, sf):
    docs = d.table(spark, sf, "documents")
    return oplog(docs, key=F.encode(F.lpad(F.col("doc_id").cast("string"), 8, "0"), "UTF-8"), seq=F.col("doc_id") + 1, op=F.lit(PUT), value=F.encode("lang", "UTF-8"))


_LOADED = "lb as (select lpad(cast(doc_id as varchar), 8, '0') as key, 'q' || max(quality) as q from labels group by doc_id), dl as (select lpad(cast(doc_id as varchar), 8, '0') as key, lang from documents)"


@query(f"with {_LOADED} select key, coalesce(q, lang) as value from dl full join lb using (key)")
def ingest_overwrite(spark, sf):
    state = resolve(ingest.ingest(_docs_log(spark, sf), [_loaded(spark, sf)], 1 << 40), ranges=False)
    return state.select(text("key").alias("key"), text("value").alias("value"))


@query(f"with {_LOADED} select key, coalesce(lang, q) as value from dl full join lb using (key)")
def ingest_behind(spark, sf):
    state = resolve(ingest.ingest(_docs_log(spark, sf), [_loaded(spark, sf)], 1 << 40, ingest.IngestOptions(behind=True)), ranges=False)
    return state.select(text("key").alias("key"), text("value").alias("value"))


@query("""with f as (select o_orderkey // 1000 as file_id, min(o_custkey) as a, max(o_custkey) as b, count(*) as n from orders group by all),
    r as (select *, max(b) over (order by a, file_id rows between unbounded preceding and 1 preceding) as reach from f) select file_id, n from r where reach >= a""")
def ingest_overlap_check(spark, sf):
    o = d.table(spark, sf, "orders")
    rows = o.select(F.floor(F.col("o_orderkey") / 1000).alias("file_id"), d.key_of("c", F.col("o_custkey"), 8).alias("key"), F.lit(PUT).alias("op"), F.lit(b"v").alias("value"))
    return ingest.overlapping(ingest.file_info(rows)).select("file_id", "n")


@query("""with r as (select o_orderkey % 7 as file_id, o_orderkey as pos, o_custkey as k from orders), p as (select *, lag(k) over (partition by file_id order by pos) as b from r)
    select file_id, pos, 'order' as reason from p where b >= k""")
def ingest_order_check(spark, sf):
    o = d.table(spark, sf, "orders")
    rows = o.select((F.col("o_orderkey") % 7).alias("file_id"), F.col("o_orderkey").alias("pos"), d.key_of("c", F.col("o_custkey"), 8).alias("key"), F.lit(PUT).alias("op"), F.lit(None).cast("binary").alias("end_key"))
    return ingest.order_errors(rows).select("file_id", "pos", "reason")


@query(f"with {_LOG} select seq, seq - (seq - 1) % 10 as batch_seq from log where seq - (seq - 1) % 10 >= 505")
def updates_since(spark, sf):
    return cdc.updates_since(d.events_log(spark, sf), 505).select("seq", "batch_seq")


@query(f"with {_LOG} select seq from log where seq - (seq - 1) % 10 >= 501")
def updates_straddling(spark, sf):
    return cdc.updates_since(d.events_log(spark, sf), 505, include_straddling=True).select("seq")


@query("select max(event_id) + 1 as latest_seq from events")
def latest_sequence(spark, sf):
    return cdc.latest_seq(d.events_log(spark, sf))


# --- codecs and prefixes


@query("select event_id, event_id as ts, true as newer_first from events")
def timestamp_codec(spark, sf):
    e = d.table(spark, sf, "events").select("event_id")
    key = codecs.append_timestamp(F.lit(b"k"), F.col("event_id"))
    newer = codecs.append_timestamp(F.lit(b"k"), F.col("event_id") + 1) < key
    return e.select("event_id", codecs.timestamp_of(key).cast("long").alias("ts"), newer.alias("newer_first"))


@query("select event_id, cast(event_id * 1000003 as bigint) as n, lower(hex(cast(event_id as varchar))) as hexed from events")
def number_codec(spark, sf):
    e = d.table(spark, sf, "events")
    n = decode_u64le(codecs.encode_u64le(F.col("event_id") * 1000003)).cast("long")
    return e.select("event_id", n.alias("n"), codecs.to_hex(F.encode(F.col("event_id").cast("string"), "UTF-8")).alias("hexed"))


@query("""select p_partkey, substr(p_name, 1, 4) as fixed, length(p_name) >= 4 as in_domain, substr(p_name, 1, 6) as capped, p_name as whole from part""")
def key_prefixes(spark, sf):
    k = F.encode("p_name", "UTF-8")
    four, six = keys.fixed(4), keys.capped(6)
    return d.table(spark, sf, "part").select("p_partkey", text(four.of(k)).alias("fixed"), four.domain(k).alias("in_domain"), text(six.of(k)).alias("capped"), text(keys.whole().of(k)).alias("whole"))


# --- beyond the reference: analytics on a resolved state


@query(f"""with {_ORDERS}, {_STATE} select n_name, c_mktsegment, count(*) as n_customers, max(seq) as last_seq from state
    join customer on key = {_C.format('c_custkey')} join nation on n_nationkey = c_nationkey group by all""")
def state_join_dim(spark, sf):
    state = latest(d.orders_log(spark, sf))
    c = d.table(spark, sf, "customer").withColumn("key", d.key_of("c", F.col("c_custkey"), 8))
    n = d.table(spark, sf, "nation")
    joined = state.join(c, "key").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n_customers"), F.max("seq").alias("last_seq"))


@query(f"with {_ORDERS}, {_STATE} select split_part(value, '|', 1) as priority, substr(key, 1, 7) as range_, count(*) as n from state group by rollup (priority, range_)")
def state_rollup(spark, sf):
    state = _shown(latest(d.orders_log(spark, sf)))
    return state.select(F.split_part("value", F.lit("|"), F.lit(1)).alias("priority"), F.substring("key", 1, 7).alias("range_")).rollup("priority", "range_").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by user after merges, deletions and range deletions."""
    return range_delete(spark, sf_dir)
