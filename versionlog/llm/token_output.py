"""Token ids as binary segments of bit-plane shuffled blocks.

Documents are dealt by ranges of doc_id and written in ascending order (nulls
first; ties by text).  A partition is a shard.  A row of the output is one segment: whole
documents, about ``segment_ids`` ids in all, so that every segment can be read
alone.  Its payload:

    magic "PLN1", u8 plane width in bits (1 or 8), u8 0, u16 0, u32 ids a block, u32 blocks,
    then the chunk index: for each block and plane a u32 compressed size,
    then the planes themselves, each a zstandard frame.

A block holds ``block_ids`` ids as little-endian unsigned 32-bit integers, the
last one fewer; plane k of a block has bit k (or byte k) of every id.  A plane
of zeros has size 0 and no frame.

The container is a Parquet folder in any Hadoop store: commits are atomic, a
task that is lost with its executor is run again, and nothing local is kept.

Defined results: a null or empty text is the end id alone; repeated ids are
separate documents, in order of text; an empty table gives an empty folder;
other columns are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import text_of
from .bpe import Shared
from .bpe_codec import Codec

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 19
#: Documents of a segment at most; only empty ones come near it.
SEGMENT_DOCS = 1 << 17
LEVEL = 3
_HEAD = struct.Struct("<4sBBHII")
SEGMENT = "shard int, segment int, first_id long, n_ids long, doc_ids array<long>, doc_sizes array<long>, payload binary"


#: Memory, in bytes, for the words that a writer remembers; twice as much at most.
MEMO_BYTES = 64 << 20


class RoomyCodec(Codec):
    """A writer's tasks have no other operator's tables beside theirs, so they may remember more words."""

    def __init__(self, t) -> None:
        super().__init__(t, MEMO_BYTES)


def planes_of(block: np.ndarray, bits: int) -> np.ndarray:
    """A row for each plane."""
    raw = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    return raw.T if bits == 8 else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")


def block_of(planes: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.ascontiguousarray(planes.T)
    else:
        raw = np.packbits(np.unpackbits(planes, axis=1, bitorder="little", count=n).T, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def pack(ids: np.ndarray, bits: int = 8, block_ids: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    sizes, frames, n_blocks = [], [], -(-len(ids) // block_ids)
    for k in range(n_blocks):
        for plane in planes_of(ids[k * block_ids : (k + 1) * block_ids], bits):
            frame = press.compress(np.ascontiguousarray(plane)) if plane.any() else b""
            sizes.append(len(frame))
            frames.append(frame)
    head = _HEAD.pack(b"PLN1", bits, 0, 0, block_ids, n_blocks)
    return b"".join([head, np.array(sizes, "<u4").tobytes(), *frames])


def unpack(payload: bytes, n_ids: int) -> np.ndarray:
    magic, bits, _, _, block_ids, n_blocks = _HEAD.unpack_from(payload)
    if magic != b"PLN1" or -(-n_ids // block_ids) != n_blocks:
        raise ValueError("not a segment of this format, or of another length")
    n_planes = 32 // bits
    sizes = np.frombuffer(payload, "<u4", n_blocks * n_planes, _HEAD.size)
    at, open_, out = _HEAD.size + sizes.nbytes, zstandard.ZstdDecompressor(), []
    for k in range(n_blocks):
        n = min(block_ids, n_ids - k * block_ids)
        width = n if bits == 8 else -(-n // 8)
        planes = np.zeros((n_planes, width), np.uint8)
        for p, size in enumerate(sizes[k * n_planes : (k + 1) * n_planes].tolist()):
            if size:
                planes[p] = np.frombuffer(open_.decompress(payload[at : at + size]), np.uint8)
                at += size
        out.append(block_of(planes, n, bits))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_tokens(
    df: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", bits: int = 8, block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS
) -> None:
    """Encode every whole text, append ``end_id``, and write the segments to ``path``."""
    shared = Shared.of(df, tokenizer)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    dealt = docs.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    dealt = dealt.withColumn("shard", F.spark_partition_id())
    kind = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, segment, first, held, names, sizes, shard, n_ids = shared.held(RoomyCodec), 0, 0, [], [], [], 0, 0

        def full() -> pa.RecordBatch:
            nonlocal segment, first, held, names, sizes, n_ids
            ids = np.concatenate(held)
            row = pa.RecordBatch.from_pylist([{"shard": shard, "segment": segment, "first_id": first, "n_ids": len(ids), "doc_ids": names, "doc_sizes": sizes, "payload": pack(ids, bits, block_ids)}], kind)
            segment, first, held, names, sizes, n_ids = segment + 1, first + len(ids), [], [], [], 0
            return row

        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                for name, ids, shard in zip(part["doc_id"].to_pylist(), codec.encode(part["text"].to_pylist()), part["shard"].to_pylist()):
                    held.append(np.append(ids, np.uint32(end_id)))
                    names.append(name)
                    sizes.append(len(held[-1]))
                    n_ids += sizes[-1]
                    if n_ids >= segment_ids or len(sizes) >= SEGMENT_DOCS:
                        yield full()
        if held:
            yield full()

    dealt.mapInArrow(run, SEGMENT).write.option("compression", "none").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: a row for each document with ``start`` (ids before it), ``n_tokens``, ``ids_crc32``.

    Segments are decoded where they lie.  Only the sizes of shards, one row for each partition
    that wrote, meet in one place.
    """
    segments = read_segments(spark, path)
    kind = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["n_ids"])
                sizes = np.array(row["doc_sizes"], np.int64)
                starts = np.cumsum(sizes) - sizes
                sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), row["shard"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first_id"]), pa.array(sizes), pa.array(sums, pa.int64())], schema=kind)

    docs = segments.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = docs.join(shards, "shard")
    return joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
