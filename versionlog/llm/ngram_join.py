"""N-gram Jaccard join: tiles by size band, bitmap bounds, exact intersections.

A document's set is its distinct word n-grams as 64-bit hashes.  Sets that link
share ``SHARED`` n-grams of their prefixes, the first (1 - t) n + SHARED in any
common order; ours puts n-grams that many documents share last.  The n-grams
found in two prefixes or more make the tiles; tiles of many members are dealt
in blocks.

1.  Equal sets collapse to the document with the smallest id.
2.  In each tile, members are held against a few pivots (in a small tile, against
    each other).  Pairs that fit in size and meet in enough tiles go on; the bit
    counts of hashed bitmaps bound their overlap from above, and what passes is
    intersected exactly.  Links merge into components.
3.  In larger tiles that still hold several components, each member is held
    against those of other components by bit counts; the best few of its pairs are
    intersected exactly, which merges most of what belongs together.  Tiles that
    had more pairs than these go on to another round with more of them, among the
    components as they are then, until no pair is left.  The largest tiles are cut
    into size bands and blocks.

So every linked pair that could join two components is tested, no pair within a
component needs to be, and neither copies nor members of a family are spelled
out as pairs.  N-grams are told apart by 64-bit hashes.

Why step 3 may leave out tiles: linked sets share SHARED tiles, or all their
n-grams if these are fewer.  A pair that meets in fewer than MET small tiles has
the rest in large ones; each document may leave out half of what is beyond that,
its largest tiles, and one tile still holds both.

Defined results: A-Z count as lower case, words lie between ASCII spaces; a
document with fewer words than n has its whole sequence as one n-gram; without
words, or with a null text, it has an empty set and links with nothing; rows
that repeat an id are one node with the links of both; a null id stands for
itself, with a null component; an empty table gives an empty table; extra
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ._io import Scratch, forget, stored, text_of, trim
from .components import components

#: N-grams that are looked at together for what many documents share.
CHUNK_GRAMS = 1_000_000
#: An n-gram is common with so many documents in a chunk, and in all.
COMMON_IN_CHUNK, COMMON = 4, 32
#: So many of the most common ones are put last; the order of the others is their hash.  Only speed hangs on it.
MOST_COMMON = 100_000
#: Members of a tile that the others are held against first; so small a tile is compared whole.
PIVOTS = 8
#: Members of a tile that one task compares with as many others.
BLOCK = 8192
#: Pairs of each member of a tile that are tried in the first round, and times as many in each further one.
BEST, MORE = 4, 16
#: So many tiles before one are known there, the most common ones; pairs that meet in others are named again.
BEFORE = 1024
#: Of its tiles each member knows so many, the least ones; two that share any of these share their first one there.
FIRST_TILES = 32
#: Pairs that are given on at once.
PAIR_ROWS = 50_000
#: Bytes of bitmaps that are compared at once.
COMPARED_BYTES = 4 << 20
#: Up to so many ids are broadcast; beyond, they are joined by shuffling.
BROADCAST_IDS = 200_000
#: What is dealt out by keys is read by a task for so many rows, or for so many n-grams, where the session has more
#: partitions than that: a task of few rows takes far longer to start, and its file to be made, than to run.
ROWS_A_TASK, GRAMS_A_TASK = 2000, 1_000_000
#: So many n-grams of their prefixes linked sets share, if they have as many in common at all; in so many small
#: tiles a pair must meet to be looked at there.
SHARED, MET = 20, 6
#: Bits of a bitmap for each n-gram, before rounding up to a power of two: in tiles, and of single pairs.  In tiles
#: there are so many at most, as every tile of a document has them; larger sets pass there more easily.
BITS_A_GRAM, FINE_BITS, TILE_BITS = 2, 4, 1 << 13

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _A
    x = (x ^ x >> np.uint64(29)) * _B
    return x ^ x >> np.uint64(32)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))
#: An odd base with 2 left after taking 1 away, and its inverse modulo 2^64.
_BASE = np.uint64(0x8D26CCFE6D9B5A5B)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts are hashed in parts of about so many bytes, cut at spaces.
PART_BYTES = 1 << 20
#: Short texts are hashed together, up to so many bytes.
TOGETHER = 1 << 17


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def words_at(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, a polynomial over its bytes, taken from running sums, then mixed; and where it begins."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(max(PART_BYTES, 1 << (len(raw) - 1).bit_length()))
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    first, end = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])])
    return _mix((sums[end] - sums[first]) * down[first] ^ (end - first).astype(np.uint64)), first


def word_hashes(raw: np.ndarray) -> np.ndarray:
    return words_at(raw)[0]


class Shingler:
    """Hashes of word n-grams."""

    def __init__(self, n: int) -> None:
        self.n = n

    def words(self, text: str) -> np.ndarray:
        return self._words(text.encode().lower())  # of bytes: A-Z only

    def _words(self, low: bytes) -> np.ndarray:
        if len(low) <= PART_BYTES:
            return word_hashes(np.frombuffer(low, np.uint8))
        raw, parts, at = np.frombuffer(low, np.uint8), [], 0
        spaces = np.flatnonzero(_SPACE[raw])
        while at < len(raw):
            k = np.searchsorted(spaces, at + PART_BYTES)
            to = int(spaces[k]) + 1 if k < len(spaces) else len(raw)
            parts.append(word_hashes(raw[at:to]))
            at = to
        return np.concatenate(parts)

    def sequence(self, text: str) -> np.ndarray:
        """Hashes of the text's n-grams in order."""
        return self._grams(self.words(text))

    def _grams(self, w: np.ndarray) -> np.ndarray:
        if not len(w):
            return w
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ w[k : len(w) - n + 1 + k]) * _A
            h ^= h >> np.uint64(29)
        h *= _B
        return h ^ h >> np.uint64(32)

    def together(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
        """The n-grams of some texts in one array, and where in it the ``sequence`` of each text lies; then of the next ones."""
        waiting, size = [], 0
        for text in texts:
            low = text.encode().lower()
            if waiting and size + len(low) >= TOGETHER:
                yield self._joined(waiting)
                waiting, size = [], 0
            waiting.append(low)
            size += len(low) + 1
        if waiting:
            yield self._joined(waiting)

    def _joined(self, lows: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        if len(lows) == 1:
            h = self._grams(self._words(lows[0]))
            return h, [(0, len(h))]
        w, first = words_at(np.frombuffer(b" ".join(lows), np.uint8))
        cut = np.searchsorted(first, np.cumsum([0] + [len(x) + 1 for x in lows])).tolist()
        h = [self._grams(w)]
        at, out = len(h[0]), []
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a >= self.n:
                out.append((a, b - self.n + 1))
            else:  # no word or one n-gram of its own
                h.append(self._grams(w[a:b]))
                out.append((at, at + len(h[-1])))
                at += len(h[-1])
        return np.concatenate(h), out

    def __call__(self, text: str) -> np.ndarray:
        """Sorted, each once."""
        return np.unique(self.sequence(text))


def prefix_size(n: int, percent: int) -> int:
    """First n-grams of which linked sets share SHARED, or all they share: n - ceil(t n) + SHARED."""
    return min(n, n - -(-percent * n // 100) + SHARED)


def bitmap(grams: np.ndarray, bits_a_gram: int, most: int | None = None) -> bytes:
    bits = 64
    while bits < bits_a_gram * len(grams) and bits != most:
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(grams & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(raw: bytes, words: int) -> np.ndarray:
    """A bitmap at a smaller power of two: bit k stands for all that are k modulo the new size."""
    m = np.frombuffer(raw, np.uint64)
    while len(m) > words:
        m = m[: len(m) // 2] | m[len(m) // 2 :]
    return m


def overlap_bound(one: np.ndarray, n_one: int, others: np.ndarray, n_others: np.ndarray) -> np.ndarray:
    """Largest overlap that the bitmaps allow: n-grams whose bits the other lacks are not shared."""
    only_one = np.bitwise_count(one & ~others).sum(axis=1, dtype=np.int64)
    only_other = np.bitwise_count(others & ~one).sum(axis=1, dtype=np.int64)
    return np.minimum(n_one - only_one, n_others - only_other)


def enough(overlap, n_one, n_other, percent: int):
    """Does the overlap make a link?  Exact in integers."""
    return 100 * overlap >= percent * (n_one + n_other - overlap)


@dataclass
class Config:
    n: int = 5
    percent: int = 80


def _common(texts: DataFrame, n: int) -> np.ndarray:
    """The n-grams that many documents share, from all n-grams of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingle, held, size = Shingler(n), [], 0

        def out() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= COMMON_IN_CHUNK
            return pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(times[often])], ["gram", "times"])

        for batch in batches:
            for x in batch["text"]:
                held.append(shingle(x.as_py()))
                size += len(held[-1])
                if size >= CHUNK_GRAMS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
        held.clear()
        trim()

    found = texts.select("text").mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    top = found.where(F.col("times") >= COMMON).orderBy(F.desc("times"), "gram").limit(MOST_COMMON)
    return np.sort(top.select("gram").toArrow()["gram"].to_numpy().view(np.uint64))


def signatures(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, n_shingles, set_hash, bits and keys (the prefix) of every document; docs has doc_id and text."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, config.n))
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingle, last = Shingler(config.n), common.value
        for batch in batches:
            sizes, hashes, bits, keys = [], [], [], []
            for x in batch["text"]:
                grams = shingle(x.as_py())
                sizes.append(len(grams))
                hashes.append(xxhash.xxh3_128_digest(grams))
                bits.append(bitmap(grams, BITS_A_GRAM, TILE_BITS))
                if not len(grams):
                    keys.append([])
                    continue
                most = prefix_size(len(grams), config.percent)
                if len(last):
                    often = last[np.minimum(np.searchsorted(last, grams), len(last) - 1)] == grams
                    grams = np.concatenate([grams[~often], grams[often]])
                keys.append(grams[:most].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=kind)
        trim()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bits binary, keys array<long>")


def _few(df: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if its size, which is counted, allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _linked(pairs: DataFrame, texts: DataFrame, config: Config, tasks: int) -> DataFrame:
    """Those of the pairs (u, v) that link: bounded by finer bitmaps, then by intersection of the sorted sets.

    A text is taken apart once; sets go only to the pairs that their bitmaps let pass.
    """
    step = Scratch(texts.sparkSession)
    tasks = max(tasks, -(-pairs.count() // ROWS_A_TASK))
    pairs = pairs.coalesce(tasks)
    ids = step.stored(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().coalesce(tasks), "join-ids")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingle = Shingler(config.n)
        for batch in batches:
            found = [shingle(x.as_py()) for x in batch["text"]]
            bits, grams = [bitmap(g, FINE_BITS) for g in found], [g.tobytes() for g in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(map(len, found), pa.int64()), pa.array(bits, pa.binary()), pa.array(grams, pa.binary())], ["id", "n", "bits", "grams"])
        trim()

    held = texts.join(_few(ids), texts["doc_id"] == ids["id"], "left_semi").select("doc_id", "text")
    made = step.stored(held.mapInArrow(take, "id long, n long, bits binary, grams binary"), "join-sets")
    for column, overlap in (("bits", _bitmap_bound), ("grams", _intersection)):
        pairs = stored(_passing_pairs(pairs, made.coalesce(tasks), column, overlap, config.percent, tasks), "join-tested")
    step.clear()
    return pairs


def _passing_pairs(pairs: DataFrame, made: DataFrame, column: str, overlap, percent: int, tasks: int) -> DataFrame:
    def passes(a: pa.Array, n_a: pa.Array, b: pa.Array, n_b: pa.Array) -> pa.Array:
        sides = zip(a, n_a.to_pylist(), b, n_b.to_pylist())
        return pa.array([bool(enough(overlap(x.as_py(), n_x, y.as_py(), n_y), n_x, n_y, percent)) for x, n_x, y, n_y in sides], pa.bool_())

    for side in "uv":
        pairs = pairs.join(made.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(f"x_{side}")), side).coalesce(tasks)
    return pairs.where(F.arrow_udf(passes, "boolean", ArrowUDFType.SCALAR)("x_u", "n_u", "x_v", "n_v")).select("u", "v")


def _bitmap_bound(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    words = min(len(x), len(y)) // 8
    return int(overlap_bound(folded(x, words), n_x, folded(y, words)[None], np.array([n_y]))[0])


def _intersection(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))


def _tiles(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by the keys, recut so that no group crosses two of them; with the ends of the groups."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        table = batch if rest is None else pa.concat_batches([rest, batch])
        new = np.zeros(len(table), bool)
        for k in keys:
            x = table[k].to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        ends = np.flatnonzero(new)
        if len(ends):
            yield table.slice(0, int(ends[-1])), ends
        rest = table.slice(int(ends[-1])) if len(ends) else table
    if rest is not None:
        yield rest, np.array([len(rest)])


def tile_pairs(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs to look at: a small tile whole, in a larger one each member with those of the least hashes."""
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, PIVOTS + 1):
        at = starts[sizes == m][:, None]
        one, other = np.triu_indices(m, 1)
        ones.append((at + one).ravel())
        others.append((at + other).ravel())
    for a, m in zip(starts[sizes > PIVOTS].tolist(), sizes[sizes > PIVOTS].tolist()):
        pivots = a + np.argsort(_mix(ids[a : a + m].astype(np.uint64)), kind="stable")[:PIVOTS]
        one, other = np.repeat(np.arange(a, a + m), PIVOTS), np.tile(pivots, m)
        once = (one > other) | ~np.isin(one, pivots)
        ones.append(one[once])
        others.append(other[once])
    return np.concatenate(ones), np.concatenate(others)


def _block(times: str) -> Column:
    """Members of a tile are dealt into blocks of about BLOCK."""
    return F.pmod(F.xxhash64("id"), F.ceil(F.col(times) / BLOCK)).cast("int")


def _near(members: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs (u, v, n_u, n_v) that fit in size and meet in as many tiles as linked sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for table, ends in _tiles(batches, ["key", "block"]):
            ids, n = table["id"].to_numpy(), table["n"].to_numpy()
            one, other = tile_pairs(ids, ends)
            fit = (100 * np.minimum(n[one], n[other]) >= percent * np.maximum(n[one], n[other])) & (ids[one] != ids[other])
            one, other = one[fit], other[fit]
            one, other = np.where(ids[one] > ids[other], one, other), np.where(ids[one] > ids[other], other, one)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[one], ids[other], n[one], n[other])], ["u", "v", "n_u", "n_v"])
        trim()

    dealt = members.select("key", _block("times").alias("block"), "id", "n").repartition("key", "block").coalesce(tasks).sortWithinPartitions("key", "block")
    met = dealt.mapInArrow(run, "u long, v long, n_u long, n_v long")
    met = met.groupBy("u", "v").agg(F.count("*").alias("times"), F.max("n_u").alias("n_u"), F.max("n_v").alias("n_v"))
    return met.coalesce(tasks).where(F.col("times") >= F.least(F.lit(MET), F.ceil(F.greatest("n_u", "n_v") * percent / 100))).select("u", "v", "n_u", "n_v")


def _passing(group: dict, maps: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (one[k], other[k]) of a tile's members those that components, sizes and bit counts let pass, with their bounds on similarity."""
    n, part = group["n"], group["component"]
    fit = (part[one] != part[other]) & (100 * np.minimum(n[one], n[other]) >= percent * np.maximum(n[one], n[other]))
    one, other = one[fit], other[fit]
    bound = overlap_bound(maps[one], n[one], maps[other], n[other])
    hit = enough(bound, n[one], n[other], percent)
    one, other, bound = one[hit], other[hit], bound[hit]
    return one, other, bound / (n[one] + n[other] - bound)


def _best(one: np.ndarray, other: np.ndarray, near: np.ndarray, best: int) -> np.ndarray:
    """Places of the pairs that are among the ``best`` nearest of either member."""
    member, pair = np.concatenate([one, other]), np.tile(np.arange(len(one)), 2)
    order = np.lexsort((-np.tile(near, 2), member))
    member, pair = member[order], pair[order]
    first = np.searchsorted(member, member)
    return np.unique(pair[np.arange(len(member)) - first < best])


def _met_before(keys: list[np.ndarray], key: int) -> np.ndarray:
    """For each member of the tile ``key`` a bitmap of the tiles before it that hold the member and others of them."""
    member, held = np.repeat(np.arange(len(keys)), [len(x) for x in keys]), np.concatenate(keys)
    member, held = member[held < key], held[held < key]
    _, which, times = np.unique(held, return_inverse=True, return_counts=True)
    place = np.full(len(times), -1)
    most = np.argsort(-times, kind="stable")[:BEFORE]
    most = most[times[most] > 1]
    place[most] = np.arange(len(most))
    out = np.zeros((len(keys), max(1, -(-len(most) // 64))), np.uint64)
    at = place[which]
    member, at = member[at >= 0], at[at >= 0]
    np.bitwise_or.at(out, (member, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return out


def _across(group: dict, percent: int, best: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of different components: of one block each with each, of two blocks each with those of the other.

    The ``best`` of each member, by their bounds; and whether there were more.  No more than these are held
    beside what is compared at once.  A pair that meets in several tiles (``keys``) is one of the first alone.
    """
    lower, block, m = group["lower"], group["block"], len(group["id"])
    words = min(map(len, group["bits"])) // 8
    maps, met = np.stack([folded(x, words) for x in group["bits"]]), _met_before(group["keys"], int(group["key"][0]))
    whole, total, waiting = group["i"][0] == group["j"][0], 0, 0
    most, found = max(1, COMPARED_BYTES // (8 * words)), []
    step = max(1, most // m)

    def best_so_far() -> list:
        one, other, near = (np.concatenate(x) for x in zip(*found))
        kept = _best(one, other, near, best)
        return [(one[kept], other[kept], near[kept])]

    for a in range(0, m, step):
        rows = np.arange(a, min(m, a + step))
        one, other = np.repeat(rows, m), np.tile(np.arange(m), len(rows))
        of_use = (other < one) & ~(lower[one] & lower[other])
        if not whole:
            of_use &= block[one] != block[other]
        one, other = one[of_use], other[of_use]
        for k in range(0, len(one), most):
            passing = _passing(group, maps, one[k : k + most], other[k : k + most], percent)
            new = ~(met[passing[0]] & met[passing[1]]).any(axis=1)
            found.append(tuple(x[new] for x in passing))
            total += len(found[-1][0])
            waiting += len(found[-1][0])
        if waiting > best * m + most:
            found, waiting = best_so_far(), 0
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    ((one, other, _),) = best_so_far()
    ids = group["id"]
    return np.maximum(ids[one], ids[other]), np.minimum(ids[one], ids[other]), len(one) < total


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Tiles of more than BLOCK members, cut: a set can link within its size band and with the band below.

    A band's members are dealt into blocks, and one block is held against another.
    """
    large = F.col("times") > BLOCK
    band = F.when(large, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.001 / percent)))).otherwise(0).cast("long")
    blocks = F.ceil(F.col("times") / BLOCK).cast("int")
    rows = rows.withColumn("block", _block("times"))
    rows = rows.withColumn("lower", F.explode(F.when(large, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rows = rows.withColumn("band", band + F.col("lower").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "times")


def _across_tiles(part: DataFrame, bits: DataFrame, percent: int, best: int, tasks: int) -> DataFrame:
    """Pairs (u, v) from the tiles of ``part`` (key, id, n, times, component) that hold several components.

    A row with a key instead says that its tile had more pairs than the best.  A block of a tile is one task's.
    """
    mixed = part.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key").coalesce(tasks)
    part = part.join(mixed, "key").coalesce(tasks)
    tiles = part.groupBy("id", "n").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST_TILES).alias("keys")).coalesce(tasks)  # rows may repeat an id
    rows = _blocks(part, percent).join(bits, "id").coalesce(tasks).join(tiles, ["id", "n"]).coalesce(tasks)
    keys, columns = ["key", "band", "i", "j"], [c for c in rows.columns if c != "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for table, ends in _tiles(batches, keys):
            held = {c: (table[c].to_pylist() if c == "bits" else table[c].to_numpy(zero_copy_only=False)) for c in columns}
            held["keys"] = [x.values.to_numpy() for x in table["keys"]]
            us, vs, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                if b - a > 1:
                    u, v, cut = _across({c: x[a:b] for c, x in held.items()}, percent, best)
                    us.append(u)
                    vs.append(v)
                    if cut:
                        more.append(int(held["key"][a]))
            pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)  # a pair meets in many tiles
            for k in range(0, pairs.shape[1], PAIR_ROWS):
                u, v = pairs[:, k : k + PAIR_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], ["u", "v", "key"])
            none = pa.nulls(len(more), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(more, pa.int64())], ["u", "v", "key"])
        trim()

    dealt = rows.repartition(*keys).coalesce(tasks).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u long, v long, key long").distinct().coalesce(tasks)


class Joined:
    """``decisions``: n_shingles and component of every document; ``keep_one``: a document of each component."""

    def __init__(self, docs: DataFrame, config: Config | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.docs, self.id_col, self.config = docs, id_col, config or Config()
        percent = self.config.percent
        texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
        signed = stored(signatures(texts, self.config), "join-signatures")
        size = signed.agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("grams")).first()
        tasks = max(1, -(-size["rows"] // ROWS_A_TASK) + (size["grams"] or 0) // GRAMS_A_TASK)
        self.signed = signed = signed.coalesce(tasks)
        step = Scratch(docs.sparkSession)
        # equal sets: the smallest id stands for all
        usable = signed.where("n_shingles > 0 and doc_id is not null")
        equal = usable.groupBy("set_hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
        equal = stored(equal.select("set_hash", "first").coalesce(tasks), "join-equal")
        copies = stored(usable.select("set_hash", "doc_id").join(_few(equal), "set_hash").where("doc_id <> first").select(F.col("first").alias("u"), F.col("doc_id").alias("v")).coalesce(tasks), "join-copies")
        single = usable.join(_few(copies.select(F.col("v").alias("doc_id")).distinct()), "doc_id", "left_anti")
        # tiles: keys of two documents or more
        rows = single.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
        tiles = rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
        tiles = step.stored(tiles.coalesce(tasks), "join-tiles")  # its shuffle files go before those of the join come
        members = step.stored(rows.join(tiles, "key").coalesce(tasks), "join-members").coalesce(tasks)
        bits = signed.select(F.col("doc_id").alias("id"), "bits")
        near = step.stored(_near(members, percent, tasks), "join-near").select("u", "v")
        edges = _linked(near, texts, self.config, tasks)
        # larger tiles that still hold several components, without those that a document may leave out
        may_go = F.floor((F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100)) - MET) / 2)
        order = Window.partitionBy("id").orderBy(F.desc("times"), "key")
        large = members.where(F.col("times") > PIVOTS).withColumn("nth", F.row_number().over(order)).where(F.col("nth") > may_go).drop("nth")
        large = step.stored(large.coalesce(tasks), "join-large").coalesce(tasks)
        best = BEST
        while not large.isEmpty():
            found = components(edges)
            part = large.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "n", "times", F.coalesce("component", "id").alias("component"))
            part = step.stored(part.coalesce(tasks), "join-parts").coalesce(tasks)
            out = step.stored(_across_tiles(part, bits, percent, best, tasks), "join-pairs").coalesce(tasks)
            pairs = step.stored(out.where("key is null").select("u", "v").join(near.coalesce(tasks), ["u", "v"], "left_anti").coalesce(tasks), "join-untested")
            edges = edges.unionByName(_linked(pairs, texts, self.config, tasks))
            more = out.where("key is not null").select("key").distinct().coalesce(tasks)
            near, large = near.unionByName(pairs), step.stored(large.join(more, "key").coalesce(tasks), "join-large").coalesce(tasks)
            best *= MORE
        # copies hang on the document that stands for their set
        self.found = components(edges.unionByName(copies))
        step.clear()

    def decisions(self) -> DataFrame:
        """doc_id, n_shingles, component_id (the smallest id reachable by links, its own included) of every document."""
        named = self.signed.select("doc_id", "n_shingles").join(self.found, F.col("doc_id") == F.col("node"), "left")
        return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

    def keep_one(self) -> DataFrame:
        """The documents with the smallest id of each component, with their own columns."""
        gone = self.decisions().where("component_id < doc_id").select(F.col("doc_id").alias("__gone"))
        gone = _few(stored(gone, "join-gone"))
        return self.docs.join(gone, self.docs[self.id_col].cast("long") == F.col("__gone"), "left_anti")
