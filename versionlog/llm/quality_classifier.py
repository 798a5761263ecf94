"""Quality classification by importance resampling.

Two bag models of hashed byte n-grams, one of target texts (labelled good) and
one of all raw texts, give each document the weight log p(x) - log q(x).  Gumbel
noise on the weights and a top-k draw the sample; ``k`` is the number of
documents whose weight reaches the cut that labelled documents kept from
fitting show to part good from bad.

Words equal to the word before are read as ``=``, so that repetition is a
feature of its own.  The raw model counts every n-gram of every document; only
the labelled rows are a sample, of ``max_labelled`` rows at most, by seeded hash.
What meets on the driver is that sample's scores, one for each label (of several
documents with its id the least), and two arrays of ``2 ** bits``
counts from each of ``MEETING`` partial sums.

Defined results: a null or empty text has no n-grams and weight 0; of several
labels of a document the worst counts; without labels of both kinds the cut is
0; documents tied with the k-th all stay; an empty table gives an empty table;
extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ._io import forget, stored, text_of, trim

BITS = 16
GRAM_BYTES = 3
MAX_LABELLED = 20_000
SEED = 42
SMOOTHING = 1.0
#: A good document lost counts as so many bad ones kept.
GOOD_OVER_BAD = 10
#: Partial sums that meet on the driver.
MEETING = 16
#: Steps of the fixed-point scores that are ranked.
STEPS = 1 << 16


def grams(text: str, bits: int = BITS, n: int = GRAM_BYTES) -> np.ndarray:
    """Buckets of the text's byte n-grams."""
    words = text.encode().split()
    marked = b" ".join([b"=" if a == b else b for a, b in zip([b"", *words], words)])
    raw = np.frombuffer(b" " + marked + b" ", np.uint8).astype(np.uint32)
    if not words or len(raw) < n:
        return np.zeros(0, np.int64)
    h = np.zeros(len(raw) - n + 1, np.uint32)
    for k in range(n):
        h = (h + raw[k : len(raw) - n + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bits: int

    def score(self, text: str) -> tuple[int, float]:
        found = grams(text, self.bits)
        return len(found), float(self.weights[found].sum())


def labelled(labels: DataFrame, quality_col: str = "quality", id_col: str = "doc_id", most: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """The bounded sample: __label_id, __good, __fit (for the target model; the others choose the cut)."""
    one = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__label_id")).agg(F.min(F.col(quality_col).cast("int")).alias("q"))
    drawn = one.withColumn("h", F.xxhash64(F.lit(seed), "__label_id")).orderBy("h", "__label_id").limit(most)
    return drawn.select("__label_id", (F.col("q") > 0).alias("__good"), (F.col("h") % 2 == 0).alias("__fit"))


def _sums(docs: DataFrame, bits: int) -> np.ndarray:
    """Counts of (raw, target) n-grams over all documents; docs has text and target."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["target"]):
                found = np.bincount(grams(text.as_py(), bits), minlength=size)
                total[0] += found
                if target.as_py():
                    total[1] += found
        yield pa.RecordBatch.from_pydict({"sums": [zstandard.compress(total.tobytes(), 1)]}, pa.schema([("sums", pa.binary())]))
        trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            for row in batch["sums"]:
                total += np.frombuffer(zstandard.decompress(row.as_py()), np.int64)
        yield pa.RecordBatch.from_pydict({"sums": [zstandard.compress(total.tobytes(), 1)]}, pa.schema([("sums", pa.binary())]))

    parts = docs.mapInArrow(count, "sums binary").repartition(MEETING).mapInArrow(add, "sums binary").collect()
    return sum((np.frombuffer(zstandard.decompress(r.sums), np.int64) for r in parts), np.zeros(2 * size, np.int64)).reshape(2, size)


def fit(raw: np.ndarray, target: np.ndarray, bits: int = BITS) -> Model:
    def log_share(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts)))

    return Model(log_share(target) - log_share(raw), bits)


def cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the best gap between held-out scores."""
    if not len(good) or not len(bad):
        return 0.0
    at = np.unique(np.concatenate([good, bad]))
    good, bad = np.sort(good), np.sort(bad)
    cost = GOOD_OVER_BAD * np.searchsorted(good, at) + len(bad) - np.searchsorted(bad, at)
    best = int(np.argmin(cost))  # keeps scores from at[best] on
    return float(at[best]) if best == 0 else float(at[best - 1] + at[best]) / 2


def gumbel(identity: Column, seed: int = SEED) -> Column:
    """Seeded noise that hangs on the identifier alone."""
    u = (F.xxhash64(F.lit(seed), F.lit("gumbel"), identity).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def threshold(scores: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by radix descent: at most 2^12 counts meet at a time."""
    if k <= 0:
        return None
    low, high, rows = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if rows == 0:
        return None
    if k >= rows:
        return low
    shift = max(0, (high - low).bit_length() - 12)
    base = low
    while True:
        within = scores.where((F.col(column) >= base) & (F.col(column) <= high))
        counts = within.groupBy(F.shiftright(F.col(column) - base, shift).alias("b")).count().collect()
        for b, n in sorted(((r["b"], r["count"]) for r in counts), reverse=True):
            if k <= n:
                break
            k -= n
        if shift == 0:
            return base + b
        base, high = base + (b << shift), min(high, base + ((b + 1) << shift) - 1)
        shift = max(0, shift - 12)


class Resampled:
    """The drawn sample: ``decisions`` of all documents, ``kept`` documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, bits: int = BITS, seed: int = SEED, carry: bool = False) -> None:
        """``carry`` holds on to the documents for ``kept``, which scores them again: no text is written beside the scores."""
        self.columns, self.seed, self.carry = docs.columns, seed, carry
        slim = docs.select(docs[id_col].cast("long").alias("__id"), text_of(docs, text_col).alias("text"))
        if carry:
            self.rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), docs[id_col].cast("long").alias("__id"), text_of(docs, text_col).alias("text"))
        # max_labelled bounds what is broadcast
        sample = F.broadcast(stored(labelled(labels, id_col="doc_id", most=max_labelled, seed=seed), "labelled"))
        marked = slim.join(sample, F.col("__id") == F.col("__label_id"), "left")
        raw, target = _sums(marked.select("text", F.coalesce(F.col("__good") & F.col("__fit"), F.lit(False)).alias("target")), bits)
        self.model = docs.sparkSession.sparkContext.broadcast(fit(raw, target, bits))
        scored = marked.withColumn("__s", self._score(F.col("text"))).select("__id", "__good", "__fit", "__s.n_grams", "__s.log_weight")
        self.scores = stored(scored.withColumn("__rank", self._rank(F.col("log_weight"), F.col("__id"))), "weights")
        # one row for each label at most, however many documents have its id
        held = self.scores.where("__good is not null and not __fit").groupBy("__id", "__good").agg(F.min("log_weight").alias("log_weight")).collect()
        self.cut = cut(np.array([r.log_weight for r in held if r["__good"]]), np.array([r.log_weight for r in held if not r["__good"]]))
        self.k = self.scores.where(F.col("log_weight") >= self.cut).count()
        self.least = threshold(self.scores, "__rank", self.k)

    def _score(self, text: Column) -> Column:
        model = self.model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            forget()
            for batch in batches:
                rows = [model.value.score(x.as_py()) for x in batch]
                yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["n_grams", "log_weight"])
            trim()

        return F.arrow_udf(run, "n_grams long, log_weight double", ArrowUDFType.SCALAR_ITER)(text)

    def _rank(self, weight: Column, identity: Column) -> Column:
        return F.round((weight + gumbel(identity, self.seed)) * STEPS).cast("long")

    def _stays(self, rank: Column) -> Column:
        return F.lit(False) if self.least is None else rank >= self.least

    def decisions(self) -> DataFrame:
        """doc_id, n_grams, log_weight, sample_key (the weight with its noise) and kept, for every document."""
        rank = F.col("__rank")
        return self.scores.select(F.col("__id").alias("doc_id"), "n_grams", "log_weight", (rank / STEPS).alias("sample_key"), self._stays(rank).alias("kept"))

    def kept(self) -> DataFrame:
        """The drawn documents, with their own columns."""
        if not self.carry:
            raise ValueError("the documents were not carried along")
        scored = self.rows.withColumn("__rank", self._rank(self._score(F.col("text"))["log_weight"], F.col("__id")))
        return scored.where(self._stays(F.col("__rank"))).select(*[F.col("__row")[c].alias(c) for c in self.columns])
