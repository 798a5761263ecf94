"""Exact deduplication over a stream with keyed state on disk.

Documents enter a queue as slim rows: digest, identifier, content locator (the
file and the row in it).  A streaming aggregation over the queue keeps, for each
digest and without expiry, the identifier and locator of the copy that stays and
the number of copies; the state lies in RocksDB and its checkpoint in the shared
folder, so a later call with the same folder goes on from there.  Where a digest
was hit twice or more, the full bytes of each copy are compared with those of
the copy that stays; should any differ, the texts of that digest are grouped by
their bytes.

All of it is DataFrame work.  Only the hits' texts move: whole texts of documents
without a copy never enter a shuffle as long as the table of hit digests is small
enough to broadcast, which is checked.  The hot digest is summed before the
shuffle, and the joins that carry its rows can be split by adaptive execution.

Defined results: texts are equal when identical after lower-casing A-Z only; a
null text counts as empty; the row with the largest identifier stays, of several
rows with that identifier the last by file and row, and a null identifier comes
before all others; exactly one row of each group stays; an empty table gives an
empty table; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import shared_dir, ship, stored

#: Up to so many hit digests (about 200 bytes each) are broadcast; beyond, they are joined by shuffling.
BROADCAST_DIGESTS = 200_000
#: New files of a queue that one micro-batch may take.
BYTES_A_BATCH = 1 << 40

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else every small store reserves disk ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # all stores of an executor share this much memory outside the heap
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
_QUEUE = "doc_id long, digest binary, path string, row long"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that to ASCII texts, and faster."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, low))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> DataFrame:
    """Documents (__own, whatever their columns are named) with the file and row of each; those that come from no file are written first."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own")
    place = (F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    try:
        return docs.select(own, *place)
    except AnalysisException:
        return stored(docs, "dedup-content").select(own, *place)


def ingest(spark: SparkSession, queue: str, state: str) -> None:
    """Take all files of the queue that the state has not seen."""
    held = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(_QUEUE).option("maxBytesPerTrigger", str(BYTES_A_BATCH)).parquet(queue)
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count("*").alias("n"))
        run = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in held.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The keyed state as a table: digest, keep (doc_id, path, row), n."""
    kept = spark.read.format("statestore").load(state)
    keep, n = kept.schema["value"].dataType.names
    return kept.select(F.col("key.digest").alias("digest"), F.col("value")[keep].alias("keep"), F.col("value")[n].alias("n"))


class Deduplicated:
    """What the stream found; ``decisions`` and ``unique`` are two views of it."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, queue: str | None = None, state: str | None = None
    ) -> None:
        """``queue`` and ``state`` name the folders of an earlier call, to go on from there with further documents.

        The files that its documents came from must still be there, as their bytes are read again on hits.
        """
        self.spark, self.columns, self.id_col, self.text_col = docs.sparkSession, docs.columns, id_col, text_col
        self.digest, self.earlier = digest, queue is not None
        ship(self.spark)
        self.docs = self._digested(located(docs))
        self.queue_path, self.state_path = queue or shared_dir(self.spark, "dedup-queue"), state or shared_dir(self.spark, "dedup-state")
        slim = self.docs.select(F.col("__id").alias("doc_id"), F.col("__digest").alias("digest"), F.col("__path").alias("path"), F.col("__row").alias("row"))
        slim.write.mode("append").parquet(self.queue_path)
        ingest(self.spark, self.queue_path, self.state_path)
        self.queue = self.spark.read.schema(_QUEUE).parquet(self.queue_path)
        self.state = stored(read_state(self.spark, self.state_path), "dedup-groups")
        hits = self.state.where("n > 1").select(F.col("digest").alias("__digest"), F.col("keep").alias("__keep"))
        self.hits = F.broadcast(hits) if hits.count() <= BROADCAST_DIGESTS else hits
        self.regrouped = self._compare()

    def _digested(self, placed: DataFrame) -> DataFrame:
        own = F.col("__own")
        norm = normalised(F.coalesce(own[self.text_col].cast("string"), F.lit("")))
        named = placed.select("__own", own[self.id_col].cast("long").alias("__id"), norm.alias("__norm"), "__path", "__row")
        return named.withColumn("__digest", self.digest(F.col("__norm")))

    def _content(self) -> DataFrame:
        """Documents of this call and of earlier ones that were hit, by their locators.  What meets on the driver is a list of files."""
        names = ["__id", "__norm", "__digest", "__path", "__row"]
        own = self.docs.select(*names)
        if not self.earlier:
            return own
        met = self.queue.join(self.hits.select(F.col("__digest").alias("digest")), "digest", "left_semi").select("path").distinct()
        files = [r.path for r in met.join(self.docs.select(F.col("__path").alias("path")).distinct(), "path", "left_anti").collect()]
        if not files:
            return own
        there = self._digested(located(self.spark.read.parquet(*files)))
        return own.unionByName(there.select(*names))

    def _compare(self) -> DataFrame | None:
        """Compare bytes on hits.  Groups of texts, if any digest has two texts; None is the rule."""
        copies = self._content().join(self.hits, "__digest").select("__digest", "__norm", F.col("__id").alias("doc_id"), F.col("__path").alias("path"), F.col("__row").alias("row"), "__keep")
        stays = (F.col("path") == F.col("__keep.path")) & (F.col("row") == F.col("__keep.row"))
        kept = copies.where(stays).select("__digest", F.col("__norm").alias("__other"))
        differ = copies.join(kept.hint("merge"), "__digest").where(F.col("__norm") != F.col("__other"))
        differ = stored(differ.select("__digest"), "dedup-collisions").distinct()
        if differ.isEmpty():
            return None
        texts = copies.join(differ, "__digest", "left_semi")
        groups = texts.groupBy("__digest", "__norm").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count("*").alias("n"))
        again = texts.select("__digest", "__norm", "path", "row").join(groups, ["__digest", "__norm"])
        return stored(again.select("path", "row", F.col("__digest").alias("digest"), "keep", "n"), "dedup-regrouped")

    def decisions(self) -> DataFrame:
        """A row for each document: doc_id, keep_id, group_size, kept, digest."""
        found = self.queue.join(self.state, "digest")
        if self.regrouped is not None:
            found = found.join(self.regrouped.select("digest").distinct(), "digest", "left_anti")
            again = self.queue.select("doc_id", "path", "row").join(self.regrouped, ["path", "row"])
            found = found.unionByName(again.select(found.columns))
        kept = (F.col("path") == F.col("keep.path")) & (F.col("row") == F.col("keep.row"))
        return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")

    def unique(self) -> DataFrame:
        """The documents that stay, with their own columns."""
        stays = F.col("__keep").isNull() | ((F.col("__path") == F.col("__keep.path")) & (F.col("__row") == F.col("__keep.row")))
        hits = self.hits
        if self.regrouped is not None:
            again = self.regrouped.select(F.col("path").alias("__path"), F.col("row").alias("__row"), F.col("keep").alias("__again"))
            joined = self.docs.join(hits, "__digest", "left").join(again, ["__path", "__row"], "left")
            joined = joined.withColumn("__keep", F.coalesce("__again", "__keep"))
            return joined.where(stays).select(*[F.col("__own")[c].alias(c) for c in self.columns])
        return self.docs.join(hits, "__digest", "left").where(stays).select(*[F.col("__own")[c].alias(c) for c in self.columns])
