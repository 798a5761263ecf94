"""Near-duplicate passages by compact windows.

The tokens of a text are its word n-grams.  Two windows of ``window`` tokens in a
row are near if ``shared`` tokens of each are found in the other, which for
distinct tokens is a Jaccard similarity of ``percent``; a passage is a run of
windows that are near windows of the other text.

1.  *Reduction.*  A near window misses window - ``shared`` tokens at most, so one with
    more tokens that no other text holds is dropped: first by one token in ``SAMPLE``
    of the whole texts, then by all tokens of what is left.
2.  *Compact windows.*  Two near windows share the least token that both hold, which is
    among the window - ``shared`` + 1 least ones of either, in any order of the tokens;
    ours puts rare ones first.  One row (token, first, end) stands for windows in a row of
    a text that have the token among their least, with a bitmap of their tokens.
3.  *Candidates.*  Rows with one token are held against each other by their bitmaps: few
    each with each, of more all with pivots.  Then those pairs follow that could still
    tell something: a word not found yet, two classes, or a text not known to hold
    what an earlier one holds; until there is none.
4.  *Pairs.*  All near windows of a pair are found, in one of three ways.  Where no text repeats
    a token, the places of a window's tokens in the other text give the intervals of its near
    windows, for many pairs together.  Texts of few different windows are held against each
    other by their tokens' counts.  Others take interval joins: the places of a token in both
    texts span window starts at an offset; a sweep finds where ``shared`` of them lie above one
    another.  Windows in which one token has ``shared`` places are near without it.

Equal texts follow the one with the smallest id and take no part in the search.  So
classes, passages and ``kept`` are those of all pairs, up to collisions of 64-bit hashes,
and a family's pairs are not spelled out; ``partners`` and ``n_links`` are those of tested pairs.

``intervals``, ``keys`` and ``longer_keys``, min-hash signatures that miss a pair now and then, take
no part in the search any more; tests state what they find.

Defined results: A-Z count as lower case, words lie between ASCII spaces; null,
empty and short texts have no passages; a text is not held against itself; rows
that repeat an id count as one document, rows with a null id are left out of the
search; an empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import forget, stored, text_of, trim
from .components import components
from .exact_dedup import normalised
from .mixing import words
from .ngram_join import Shingler, _few

#: Of the tokens of whole texts one in so many is counted.
SAMPLE = 3
#: Tokens that are dealt at once.
CHUNK_TOKENS = 1 << 20
#: Up to so many holders of a key are all held against each other.
FEW = 4
#: Partners of a key's holder in the first further round, and times as many in each next one.
PIVOTS, MORE_PIVOTS = 32, 64
#: Pairs that wait at most to be made distinct, beside those that are.
PAIRS = 1 << 18
#: Bits of a bitmap of the tokens around a key.
BITS = 512
#: Texts that a pivot is sent along with.
BESIDE = 256
#: Places that a sweep takes at once.
PART = 1 << 18
#: Places and windows that are held against each other at once.
EACH = 1 << 21
#: Windows of a text that are held first against another text that can tell no new words.
TRIED = 4
#: Numbers in a table of windows and tokens, or of pairs of windows, at most.
FEW_WINDOWS = 1 << 18
#: Low bits that hold a token's place beside its hash.
PLACE_BITS = 26

_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(PLACE_BITS)
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_MOST = np.uint64(2**64 - 1)


@dataclass
class Config:
    n: int = 5
    window: int = 46  # of five words each: 50 words
    percent: int = 80
    hashes: int = 12  # an even number
    enough: int = 6  # of them agree on two windows that are verified

    @property
    def shared(self) -> int:
        """Of two sets of ``window`` tokens, so many in common make the similarity."""
        return -(-2 * self.percent * self.window // (100 + self.percent))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(32)


def running_minimum(x: np.ndarray, window: int) -> np.ndarray:
    """Of each ``window`` values in a row, by doubling."""
    size = 1
    while 2 * size <= window:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - window + size], x[window - size :])


def compact_windows(hashed: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compact windows (first, node, last) that are at least ``window`` long, by node.

    ``hashed`` has the place of each token in its low bits, and 0 for a gap between two texts, which no span crosses.
    The tree is that of the long nodes alone: a long node's neighbours with smaller hashes are its ancestors, so they
    are long too.
    """
    if len(hashed) < window:
        return (np.zeros(0, np.int64),) * 3
    least = running_minimum(hashed, window)
    nodes = least[np.concatenate([[True], least[1:] != least[:-1]])]
    gap = nodes == 0
    if gap.any():  # a gap's place is not in its bits
        gaps = np.flatnonzero(hashed == 0)
        places = np.concatenate([(nodes[~gap] & _PLACE).astype(np.int64), gaps])
        nodes = np.concatenate([nodes[~gap], np.zeros(len(gaps), np.uint64)])
        order = np.argsort(places, kind="stable")
        places, nodes = places[order], nodes[order]
    else:
        places = (nodes & _PLACE).astype(np.int64)
    at, value = places.tolist(), nodes.tolist()
    first, last, stack = [0] * len(at), [len(hashed) - 1] * len(at), []
    for k, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            last[stack.pop()] = at[k] - 1
        first[k] = at[stack[-1]] + 1 if stack else 0
        stack.append(k)
    kept = nodes > 0
    return np.array(first, np.int64)[kept], places[kept], np.array(last, np.int64)[kept]


@dataclass
class Intervals:
    """Window starts start[k] .. end[k] that share a min-hash; rows lie in order and do not overlap.

    ``token`` is the one with the least hash, at ``node``.
    """

    start: np.ndarray
    end: np.ndarray
    token: np.ndarray
    node: np.ndarray


def intervals(tokens: np.ndarray, gaps: np.ndarray, config: Config) -> list[Intervals]:
    """For each hash function; ``gaps`` marks the places between texts."""
    out, w, n = [], config.window, np.arange(len(tokens), dtype=np.uint64)
    seeds = np.arange(1, config.hashes + 1, dtype=np.uint64) * _MIX
    for f in range(config.hashes):
        hashed = (_mix(tokens + seeds[f]) >> _LOW << _LOW) | (np.uint64(1) << _LOW) | n
        hashed[gaps] = 0
        first, node, last = compact_windows(hashed, w)
        start, end, token = np.maximum(first, node - w + 1), np.minimum(node, last - w + 1), tokens[node]
        if len(node):  # nodes of one token in a row have the same min-hash: one interval
            new = np.ones(len(node), bool)
            new[1:] = (token[1:] != token[:-1]) | (start[1:] != end[:-1] + 1)
            begin = np.flatnonzero(new)
            start, token, node, end = start[begin], token[begin], node[begin], end[np.append(begin[1:] - 1, len(node) - 1)]
        out.append(Intervals(start, end, token, node))
    return out


def _overlaid(one: Intervals, other: Intervals) -> Intervals:
    """The join of two lists of intervals over the same window starts, with a token that stands for both."""
    start = np.union1d(one.start, other.start)
    a, b = np.searchsorted(one.start, start, "right") - 1, np.searchsorted(other.start, start, "right") - 1
    return Intervals(start, np.minimum(one.end[a], other.end[b]), _mix(one.token[a] * _MIX ^ _mix(other.token[b])), start)


def keys(tokens: np.ndarray, gaps: np.ndarray, config: Config) -> list[Intervals]:
    """For each two hash functions the pairs of min-hashes of the windows."""
    of = intervals(tokens, gaps, config)
    found = [_overlaid(of[f], of[f + 1]) for f in range(0, config.hashes, 2)]
    for band, x in enumerate(found):
        x.token = x.token ^ np.uint64(band)
    return found


def longer_keys(found: list[Intervals], weak: np.ndarray) -> list[Intervals]:
    """Joins of two keys of a window that are both among the ``weak`` ones (sorted)."""
    out = []
    chosen = []
    for x in found:
        is_weak = weak[np.minimum(np.searchsorted(weak, x.token), len(weak) - 1)] == x.token
        chosen.append(is_weak)
    for a in range(len(found)):
        for b in range(a + 1, len(found)):
            both = _overlaid(found[a], found[b])
            if len(both.start):
                stays = chosen[a][np.searchsorted(found[a].start, both.start, "right") - 1] & chosen[b][np.searchsorted(found[b].start, both.start, "right") - 1]
                out.append(Intervals(both.start[stays], both.end[stays], both.token[stays], both.node[stays]))
    return out


# --- tokens that several texts hold, and windows that may be near others


def _sampled(tokens: np.ndarray) -> np.ndarray:
    """Which tokens are counted in whole texts: one in SAMPLE, by hash."""
    return _mix(tokens ^ _MIX) % np.uint64(SAMPLE) == 0


def _sequences(shingle: Shingler, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tokens of each text, and which of them are counted."""
    for tokens, bounds in shingle.together(texts):
        counted = _sampled(tokens)
        for a, b in bounds:
            yield tokens[a:b], counted[a:b]


def _distinct(tokens: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    tokens = np.sort(tokens)
    new = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
    return tokens[new]


def _parts(df: DataFrame) -> int:
    """A prime near the number of shuffle partitions, so that ids with a common step are dealt evenly."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _blobs(part: np.ndarray, parts: int, columns: dict[str, np.ndarray], name: str) -> pa.RecordBatch:
    """Rows dealt by ``part``: for each part one row with its values as bytes."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(cut))
    made = [pa.array([x[order[cut[k] : cut[k + 1]]].tobytes() for k in some], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *made], [name, *columns])


def _counted(rows: DataFrame, column: str, distinct_tokens, parts: int) -> DataFrame:
    """part, docs, tokens, times: the tokens that several rows (doc, column) hold, with their number, dealt by doc.

    Tokens travel as bytes, by hash and back by doc, and are counted in arrays.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        docs, held, size = [], [], 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            owner = np.repeat(np.array(docs, np.int64), [len(x) for x in held])
            return _blobs((_mix(tokens) % np.uint64(parts)).astype(np.int64), parts, {"docs": owner, "tokens": tokens}, "bucket")

        take = distinct_tokens()
        for batch in batches:
            for doc, tokens in zip(batch["doc"].to_pylist(), take(x.as_py() for x in batch[column])):
                if len(tokens):
                    docs.append(doc)
                    held.append(tokens)
                    size += len(tokens)
                if size >= CHUNK_TOKENS:
                    yield out()
                    docs, held, size = [], [], 0
        if held:
            yield out()
        docs, held = [], []
        trim()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        at, docs, held = None, [], []

        def out() -> pa.RecordBatch:
            tokens, owner = np.concatenate(held), np.concatenate(docs)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            sizes = np.diff(np.append(starts, len(tokens)))
            times = np.repeat(sizes, sizes)
            several = times > 1
            owner = owner[several]
            return _blobs(np.mod(owner, parts), parts, {"docs": owner, "tokens": tokens[several], "times": times[several].astype(np.int32)}, "part")

        for batch in batches:
            for bucket, d, t in zip(batch["bucket"].to_pylist(), batch["docs"], batch["tokens"]):
                if bucket != at and held:
                    yield out()
                    docs, held = [], []
                at = bucket
                docs.append(np.frombuffer(d.as_py(), np.int64))
                held.append(np.frombuffer(t.as_py(), np.uint64))
        if held:
            yield out()
        docs, held = [], []
        trim()

    dealt = rows.select("doc", column).mapInArrow(deal, "bucket int, docs binary, tokens binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "part int, docs binary, tokens binary, times binary")


class _Times:
    """In how many rows the tokens of the rows of a part are; a token that is not listed is in one."""

    def __init__(self) -> None:
        self.part, self.blobs, self.docs = None, [], None

    def add(self, part: int, docs: bytes, tokens: bytes, times: bytes) -> None:
        if part != self.part:
            self.part, self.blobs = part, []
        self.blobs.append((np.frombuffer(docs, np.int64), np.frombuffer(tokens, np.uint64), np.frombuffer(times, np.int32)))
        self.docs = None

    def of(self, part: int, doc: int, tokens: np.ndarray) -> np.ndarray:
        out = np.ones(len(tokens), np.int64)
        if part != self.part or not self.blobs:
            return out
        if self.docs is None:
            docs, held, times = (np.concatenate(x) for x in zip(*self.blobs))
            order = np.lexsort((held, docs))
            self.docs, self.tokens, self.times = docs[order], held[order], times[order]
            self.blobs = [(self.docs, self.tokens, self.times)]
        a, b = np.searchsorted(self.docs, doc, "left"), np.searchsorted(self.docs, doc, "right")
        if a < b:
            held = self.tokens[a:b]
            at = np.minimum(np.searchsorted(held, tokens), b - a - 1)
            known = held[at] == tokens
            out[known] = self.times[a:b][at[known]]
        return out


def _beside(rows: DataFrame, counted: DataFrame, parts: int, payload: str) -> DataFrame:
    """Rows (doc, ...) in order of their part, after the counted tokens of that part."""
    names = [c for c in rows.columns if c != "doc"]
    kinds = dict(rows.dtypes)
    blank = [F.lit(None).cast("binary").alias(f"c_{c}") for c in ("docs", "tokens", "times")]
    one = rows.select(F.pmod(F.col("doc"), F.lit(parts)).cast("int").alias("part"), "doc", *names, *blank)
    other = counted.select("part", F.lit(None).cast("long").alias("doc"), *(F.lit(None).cast(kinds[c]).alias(c) for c in names), *(F.col(c).alias(f"c_{c}") for c in ("docs", "tokens", "times")))
    return one.unionByName(other).repartition("part").sortWithinPartitions("part", F.col(payload).isNotNull())


def _listed(batch: pa.RecordBatch, times: _Times) -> Iterator[int]:
    """Rows of the batch, once the counted tokens among them are added to ``times``."""
    parts, docs = batch["part"].to_pylist(), batch["doc"].to_pylist()
    for k, doc in enumerate(docs):
        if doc is None:
            times.add(parts[k], *(batch[f"c_{c}"][k].as_py() for c in ("docs", "tokens", "times")))
        else:
            yield k


def _windows_with_few(bad: np.ndarray, window: int, most: int) -> np.ndarray:
    """Which windows hold ``most`` bad tokens at most; one flag for each token, False for the last ones."""
    sums = np.concatenate([[0], np.cumsum(bad)])
    out = np.zeros(len(bad), bool)
    out[: len(bad) - window + 1] = sums[window:] - sums[:-window] <= most
    return out


def _covered(valid: np.ndarray, window: int) -> np.ndarray:
    """Places of the tokens of valid windows."""
    change = np.concatenate([valid.astype(np.int64), np.zeros(window, np.int64)])
    change[window:] -= valid
    return np.flatnonzero(np.cumsum(change)[: len(valid)])


def reduced(texts: DataFrame, config: Config) -> DataFrame:
    """doc, tokens, place, valid: the tokens of windows that may be near others; a window's start is ``valid``.

    A window with more tokens that no other text holds than a near one may miss is near none.  One token in SAMPLE
    is counted here, the others count as shared.
    """
    rows = texts.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "text")
    parts = _parts(texts)

    def distinct_tokens():
        shingle = Shingler(config.n)

        def take(texts: Iterable[str]) -> Iterator[np.ndarray]:
            for tokens, counted in _sequences(shingle, texts):
                yield _distinct(tokens[counted]) if len(tokens) >= config.window else tokens[:0]

        return take

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingle, times = Shingler(config.n), _Times()
        for batch in batches:
            out, docs, parts_ = [], batch["doc"].to_pylist(), batch["part"].to_pylist()
            held = _sequences(shingle, (x.as_py() for doc, x in zip(docs, batch["text"]) if doc is not None))
            for k in _listed(batch, times):
                doc, (tokens, bad) = docs[k], next(held)
                if len(tokens) < config.window:
                    continue
                bad[bad] = times.of(parts_[k], doc, tokens[bad]) < 2
                valid = _windows_with_few(bad, config.window, config.window - config.shared)
                if valid.any():
                    at = _covered(valid, config.window)
                    out.append((doc, tokens[at].tobytes(), at.astype(np.int32).tobytes(), valid[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[c] for x in out], pa.binary()) for c in (1, 2, 3))], ["doc", "tokens", "place", "valid"])
        trim()

    return _beside(rows, _counted(rows, "text", distinct_tokens, parts), parts, "text").mapInArrow(reduce, "doc long, tokens binary, place binary, valid binary")


_HELD = pa.struct([("key", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])


def least_tokens(tokens: np.ndarray, times: np.ndarray, valid: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of an order above one: places of tokens, with the first and last window that holds them among its least.

    Two windows that miss ``most`` tokens of each other at most share the least token that both hold, which is among the
    ``most`` + 1 least ones of either, each place of a token counting, as those before it are all missed.  Rare tokens
    come first, so that a key has few holders; those that no other text holds are no keys.
    """
    w, most = config.window, config.window - config.shared
    level = np.frexp(times.astype(np.float64))[1].astype(np.uint64)
    value = level << np.uint64(58) | _mix(tokens) >> np.uint64(6)
    starts = np.flatnonzero(valid)
    least = np.zeros(len(tokens), np.uint64)  # of each valid window the greatest of its least tokens
    for a in range(0, len(starts), 1 << 14):
        at = starts[a : a + (1 << 14)]
        held = np.lib.stride_tricks.sliding_window_view(value, w)[at]
        least[at] = np.partition(held, most, axis=1)[:, most] if most < w else _MOST
    ahead = np.concatenate([np.zeros(w - 1, np.uint64), least])
    nodes = np.flatnonzero((value <= ~running_minimum(~ahead, w)) & (times > 1))
    first, last = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    for a in range(0, len(nodes), 1 << 14):
        p = nodes[a : a + (1 << 14)]
        holds = np.lib.stride_tricks.sliding_window_view(ahead, w)[p] >= value[p][:, None]
        first[a : a + (1 << 14)] = p - w + 1 + holds.argmax(axis=1)
        last[a : a + (1 << 14)] = p - holds[:, ::-1].argmax(axis=1)
    return nodes, first, last


def met(tokens: np.ndarray, nodes: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of one token that meet are one, cut anew into parts of ``window`` windows at most: token, number of the whole, first, last.

    A word that is said over and over has a place in each window; else each would be a row.
    """
    order = np.lexsort((first, tokens[nodes]))
    token, first, last = tokens[nodes][order], first[order], last[order]
    if not len(token) or not (token[1:] == token[:-1]).any():
        return token, np.arange(len(token)), first, last
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    number = np.cumsum(new) - 1  # of the token: lifts it above the windows of those before it
    lift = number * (int(last.max()) + 2)
    reach = np.maximum.accumulate(last + lift)
    new[1:] |= (first + lift)[1:] > reach[:-1] + 1
    begin = np.flatnonzero(new)
    token, first, last = token[begin], first[begin], (reach - lift)[np.append(begin[1:] - 1, len(new) - 1)]
    size = last - first + 1
    parts = -(-size // window)
    whole = np.repeat(np.arange(len(token)), parts)
    k = np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = first[whole] + k * window
    return token[whole], whole, starts, np.minimum(starts + window - 1, last[whole])


def around(tokens: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A bitmap of the tokens first .. end for each row."""
    out = np.zeros((len(first), BITS // 8), np.uint8)
    bit = (tokens >> np.uint64(7) & np.uint64(BITS - 1)).astype(np.int64)
    for a in range(0, len(first), 1 << 12):
        f, e = first[a : a + (1 << 12)], end[a : a + (1 << 12)]
        size = e - f
        row = np.repeat(np.arange(len(f)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(f, size)
        flags = np.zeros((len(f), BITS), np.uint8)
        flags[row, bit[at]] = 1
        out[a : a + (1 << 12)] = np.packbits(flags, axis=1, bitorder="little")
    return out


def holders(parts_: DataFrame, config: Config) -> DataFrame:
    """doc, tokens, place, valid, held: as ``reduced``, all tokens being counted, with the compact windows of each row.

    Words first .. end are those of the windows that have the key; ``n`` tokens of theirs are in ``bits``.
    """
    parts = _parts(parts_)
    schema = pa.schema([("doc", pa.int64()), ("tokens", pa.binary()), ("place", pa.binary()), ("valid", pa.binary()), ("held", pa.list_(_HELD))])

    def distinct_tokens():
        return lambda raws: (_distinct(np.frombuffer(raw, np.uint64)) for raw in raws)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        times = _Times()
        w, length = config.window, config.window + config.n - 1
        for batch in batches:
            out, lists = [], []
            for k in _listed(batch, times):
                doc, tokens = batch["doc"][k].as_py(), np.frombuffer(batch["tokens"][k].as_py(), np.uint64)
                place, valid = np.frombuffer(batch["place"][k].as_py(), np.int32), np.frombuffer(batch["valid"][k].as_py(), bool)
                n = times.of(batch["part"][k].as_py(), doc, tokens)
                valid = valid & _windows_with_few(n < 2, w, w - config.shared)
                if not valid.any():
                    continue
                at = _covered(valid, w)
                tokens, place, valid, n = tokens[at], place[at], valid[at], n[at]
                key, whole, first, last = met(tokens, *least_tokens(tokens, n, valid, config), w)
                bits, size = around(tokens, first, last + w), last + w - first
                key, begin, end = key.view(np.int64), place[first], place[last] + length
                if len(np.unique(whole)) < len(whole):  # parts of one whole that look alike are one
                    what = np.concatenate([whole[:, None].view(np.uint8), size[:, None].view(np.uint8), bits], axis=1)
                    _, one, group = np.unique(what.view(f"V{what.shape[1]}").ravel(), return_index=True, return_inverse=True)
                    begin_, end_ = np.full(len(one), np.iinfo(np.int32).max, np.int64), np.zeros(len(one), np.int64)
                    np.minimum.at(begin_, group, begin)
                    np.maximum.at(end_, group, end)
                    key, size, bits, begin, end = key[one], size[one], bits[one], begin_, end_
                out.append((doc, tokens.tobytes(), place.tobytes(), valid.tobytes()))
                lists.append((key, begin, end, size, bits))
            if not out:
                continue
            ends = np.cumsum([0] + [len(x[0]) for x in lists]).astype(np.int32)
            key, begin, end, size = (np.concatenate([x[c] for x in lists]) for c in range(4))
            raw = np.concatenate([x[4] for x in lists])
            bits = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * (BITS // 8)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
            rows = pa.StructArray.from_arrays([pa.array(key, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (begin, end, size)), bits], fields=list(_HELD))
            plain = [pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[c] for x in out], pa.binary()) for c in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([*plain, pa.ListArray.from_arrays(pa.array(ends), rows)], schema=schema)
        trim()

    kinds = "doc long, tokens binary, place binary, valid binary, held array<struct<key:long,first:int,end:int,n:int,bits:binary>>"
    return _beside(parts_, _counted(parts_, "tokens", distinct_tokens, parts), parts, "tokens").mapInArrow(make, kinds)


# --- candidates


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by key, recut so that no key crosses two of them; with the ends of the keys."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy()
        if waiting and key[-1] == waiting[0]["key"][0].as_py():
            waiting.append(batch)
            continue
        table = pa.concat_batches([*waiting, batch])
        key = table["key"].to_numpy()
        ends = np.flatnonzero(key[1:] != key[:-1]) + 1
        if len(ends):
            yield table.slice(0, int(ends[-1])), ends
            table = table.slice(int(ends[-1]))
        waiting = [table]
    if waiting:
        table = pa.concat_batches(waiting)
        yield table, np.array([len(table)])


def _fit(bits: np.ndarray, n: np.ndarray, one: np.ndarray, other: np.ndarray, shared: int) -> np.ndarray:
    """Of pairs of rows, may windows around the two places share enough?  A bit that the other lacks is a token that it lacks."""
    out = np.zeros(len(one), bool)
    for a in range(0, len(one), 1 << 15):
        i, j = one[a : a + (1 << 15)], other[a : a + (1 << 15)]
        x, y = bits[i], bits[j]
        out[a : a + (1 << 15)] = (n[i] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) >= shared) & (n[j] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64) >= shared)
    return out


class _Pairs:
    """Distinct pairs of documents, made so from time to time: rows of a group may meet far more often."""

    def __init__(self, docs: np.ndarray) -> None:
        self.docs, self.new, self.size, self.pairs = docs, [], 0, np.zeros((2, 0), np.int64)

    def add(self, one: np.ndarray | int, other: np.ndarray) -> None:
        x, y = np.broadcast_to(self.docs[one], len(other)), self.docs[other]
        self.new.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        self.size += len(other)
        if self.size > PAIRS + self.pairs.shape[1]:
            self.distinct()

    def distinct(self) -> np.ndarray:
        u, v = np.concatenate([self.pairs, *self.new], axis=1)
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        first = np.ones(len(u), bool)
        first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        self.pairs, self.new, self.size = np.stack([u[first], v[first]]), [], 0
        return self.pairs


def first_pairs(docs: np.ndarray, bits: np.ndarray, n: np.ndarray, ends: np.ndarray, shared: int) -> tuple[np.ndarray, list[int]]:
    """Pairs to test: of few holders all, of more those with a pivot; and groups of which some pairs are left.

    The first row is a pivot, then the first that fits none before, and so on; a pivot meets all that fit it.
    """
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    found, more = _Pairs(docs), []
    for m in range(2, FEW + 1):
        at = starts[sizes == m][:, None]
        one, other = np.triu_indices(m, 1)
        one, other = (at + one).ravel(), (at + other).ravel()
        fit = docs[one] != docs[other]
        one, other = one[fit], other[fit]
        fit = _fit(bits, n, one, other, shared)
        found.add(one[fit], other[fit])
    for k in np.flatnonzero(sizes > FEW).tolist():
        rows = np.arange(starts[k], ends[k])
        left, plain = rows, 0
        while len(left):
            pivot = left[0]
            fit = rows[docs[rows] != docs[pivot]]
            fit = fit[_fit(bits, n, np.full(len(fit), pivot), fit, shared)]
            found.add(pivot, fit)
            still = left[1:][~np.isin(left[1:], fit, assume_unique=True)]
            plain += len(left) - 1 - len(still)
            left = still
        if plain > 1:
            more.append(k)
    return found.distinct(), more


def further_pairs(table: dict, bits: np.ndarray, ends: np.ndarray, shared: int, best: int) -> tuple[np.ndarray, list[int]]:
    """Pairs that may still tell something, ``best`` for each row; and groups that have more of them."""
    docs, n, settled, later, part = (table[c] for c in ("doc", "n", "settled", "later", "class"))
    found, more, a = _Pairs(docs), [], 0
    for k, b in enumerate(ends.tolist()):
        rows, cut = np.arange(a, b), False
        classes, sizes = np.unique(part[a:b], return_counts=True)
        plain = settled[a:b] & (part[a:b] == classes[sizes.argmax()]) & (later[a:b] | (docs[a:b] == docs[a]))
        for i in rows[~plain].tolist():  # two plain rows tell nothing; rows lie by doc
            j = rows[(docs[a:b] != docs[i]) & (plain | (rows > i))]
            j = j[~(settled[i] & settled[j] & later[np.maximum(i, j)] & (part[j] == part[i]))]
            if len(j):
                j = j[_fit(bits, n, np.full(len(j), i), j, shared)]
                cut |= len(j) > best
                found.add(i, j[:best])
        if cut:
            more.append(k)
        a = b
    return found.distinct(), more


def _candidates(rows: DataFrame, config: Config, choose) -> DataFrame:
    """Pairs (u, v) of the rows' docs, u < v; a row with a key instead says that the key has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for table, ends in _groups(batches):
            held = {c: table[c].to_numpy(zero_copy_only=False) for c in table.schema.names if c != "bits"}
            held["n"] = held["n"].astype(np.int64)
            bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(table), -1)
            pairs, more = choose(held, bits, ends, config.shared)
            none, keys = pa.nulls(len(more), pa.int64()), pa.array(held["key"][ends[more] - 1] if more else [], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], ["u", "v", "key"])
            yield pa.RecordBatch.from_arrays([none, none, keys], ["u", "v", "key"])
        trim()

    return rows.repartition(_parts(rows), "key").sortWithinPartitions("key", "doc").mapInArrow(run, "u long, v long, key long").distinct()


# --- two texts


class Windows:
    """A text's tokens, which windows are looked at, and what looking tokens up needs.

    Windows that hold the same tokens in order are near to the same windows: ``content`` numbers them, and only the
    first of each is looked at.
    """

    def __init__(self, tokens: np.ndarray, valid: np.ndarray, window: int) -> None:
        self.tokens, self.looked, self.rules, self.window = tokens, valid, None, window
        self.sorted = np.sort(tokens)
        same = self.sorted[1:] == self.sorted[:-1]
        self.known = len(tokens) - int(np.count_nonzero(same))
        self.distinct = self.known == len(tokens)
        if not self.distinct:
            self.starts = np.flatnonzero(valid)
            self.kinds, first, self.content = np.unique(_window_hashes(tokens, window)[self.starts], return_index=True, return_inverse=True)
            self.looked = np.zeros(len(tokens), bool)
            self.looked[self.starts[first]] = True

    @cached_property
    def order(self) -> np.ndarray:
        """Places by token, equal tokens by place."""
        return np.argsort(self.tokens, kind="stable")

    @cached_property
    def repeating(self) -> np.ndarray:
        """Which windows hold a token twice or more."""
        change = np.zeros(len(self.tokens) + 1, np.int64)
        if not self.distinct:
            k = np.flatnonzero((self.sorted[1:] == self.sorted[:-1]) & (np.diff(self.order) < self.window))
            np.add.at(change, np.maximum(self.order[k + 1] - self.window + 1, 0), 1)
            np.add.at(change, self.order[k] + 1, -1)
        return np.cumsum(change)[:-1] > 0

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct tokens, the looked-at windows, and how often each of these holds each token."""
        new = np.concatenate([[True], self.sorted[1:] != self.sorted[:-1]])
        rank = np.empty(len(new), np.int64)
        rank[self.order] = np.cumsum(new) - 1
        at = np.flatnonzero(self.looked)
        rows = np.lib.stride_tricks.sliding_window_view(rank, self.window)[at] + (np.arange(len(at)) * self.known)[:, None]
        return self.sorted[new], at, np.bincount(rows.ravel(), minlength=len(at) * self.known).reshape(len(at), -1).astype(np.float32)

    def standing(self, flags: np.ndarray) -> np.ndarray:
        """Flags of windows as those of the looked-at ones that stand for them."""
        if self.distinct:
            return flags & self.looked
        held = np.zeros(self.content.max(initial=-1) + 1, bool)
        held[self.content[flags[self.starts]]] = True
        at = np.flatnonzero(self.looked)
        out = np.zeros(len(flags), bool)
        out[at] = held[self.content[np.searchsorted(self.starts, at)]]
        return out

    def ruled(self, config: Config) -> tuple[np.ndarray, np.ndarray]:
        """Looked-at windows of which one token makes up enough to be near, with that token; one that is said over and over."""
        w, more = config.window, config.shared - 1
        if self.distinct or 2 * config.shared <= w or len(self.tokens) < w:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if self.rules is None:
            k = np.flatnonzero((self.sorted[more:] == self.sorted[: len(self.sorted) - more]) & (self.order[more:] - self.order[: len(self.order) - more] < w))
            begin, size = self.order[k + more] - w + 1, self.order[k] - self.order[k + more] + w
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            inside = (at >= 0) & (at <= len(self.tokens) - w)
            at, one = np.unique(at[inside], return_index=True)
            token = np.repeat(self.sorted[k], size)[inside][one]
            self.rules = at[self.looked[at]], token[self.looked[at]]
        return self.rules

    def alike(self, starts: np.ndarray) -> np.ndarray:
        """The starts and those of windows with the same content."""
        if self.distinct or not len(starts):
            return starts
        held = np.zeros(self.content.max() + 1, bool)
        held[self.content[np.searchsorted(self.starts, starts)]] = True
        return self.starts[held[self.content]]


def windows_of(texts: list[np.ndarray], config: Config) -> list[Windows]:
    """Of each text, all windows being looked at."""
    return [Windows(t, np.arange(len(t)) <= len(t) - config.window, config.window) for t in texts]


def _window_hashes(tokens: np.ndarray, window: int) -> np.ndarray:
    """A hash of each ``window`` tokens in a row, in order, by doubling."""
    x, size = _mix(tokens), 1
    while 2 * size <= window:
        x = _mix(x[:-size] * _MIX + x[size:])
        size *= 2
    rest = window - size
    return _mix(x[: len(x) - rest] * _MIX + x[rest:])


def _slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of a list so that the weights of a part come to about ``most``, a part having one member at least."""
    total, at = np.cumsum(weights), 0
    while at < len(total):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield at, to
        at = to


def _wanted(one: Windows, other: Windows, config: Config) -> np.ndarray:
    """Windows of ``one`` that are looked at and hold enough tokens that ``other`` has anywhere."""
    inside = other.sorted[np.minimum(np.searchsorted(other.sorted, one.tokens), len(other.sorted) - 1)] == one.tokens
    return one.looked & _windows_with_few(~inside, config.window, config.window - config.shared)


def _both(one: Windows, other: Windows, x: np.ndarray, y: np.ndarray, config: Config) -> np.ndarray:
    """For pairs of windows: does the one at ``x`` hold enough of the tokens of the one at ``y``?"""
    out, w = np.zeros(len(x), bool), np.arange(config.window)
    for a in range(0, len(x), 1 << 10):
        mine, theirs = one.tokens[x[a : a + (1 << 10), None] + w], other.tokens[y[a : a + (1 << 10), None] + w]
        out[a : a + (1 << 10)] = (theirs[:, :, None] == mine[:, None, :]).any(2).sum(1) >= config.shared
    return out


def _offsets(seen: np.ndarray, config: Config) -> np.ndarray:
    """Those at which tokens lie, and those at which windows may be near all the same.

    These lie where tokens count on both sides, or where the window at the offset of some is none.
    """
    w, miss = config.window, config.window - config.shared
    reach = np.minimum(np.diff(seen, append=seen[-1] + 4 * w), 4 * w)
    until = np.where(reach < 2 * w, reach - 1, miss)
    since = np.where(np.concatenate([[4 * w], reach[:-1]]) < 2 * w, 0, miss)
    size = since + until + 1
    return np.unique(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size + since, size) + np.repeat(seen, size))


def _sweep(one: Windows, other: Windows, xs: np.ndarray, ys: np.ndarray, hit_x: np.ndarray, hit_y: np.ndarray, config: Config, main: bool = False) -> None:
    """Marks near windows, of those that are flagged in ``xs`` and ``ys``: all, or those at the main offsets.

    Interval join: a token at p of ``one`` and q of ``other`` counts, at the offset o, for the windows x of ``one`` that hold
    p and whose counterpart x + o holds q; a sweep over x finds where enough lie above one another.
    """
    w = config.window
    here, there = _covered(xs, w), _covered(ys, w)
    rows = there[np.argsort(other.tokens[there], kind="stable")]  # equal tokens lie by place
    sorted_ = other.tokens[rows]
    low = np.zeros(len(one.tokens), np.int64)
    times = np.zeros(len(one.tokens), np.int64)
    low[here] = np.searchsorted(sorted_, one.tokens[here], "left")
    times[here] = np.searchsorted(sorted_, one.tokens[here], "right") - low[here]
    starts = np.flatnonzero(xs)
    sums = np.concatenate([[0], np.cumsum(times)])
    for s0, s1 in _slices(np.diff(sums[starts], prepend=sums[starts[0]]) + 1, PART):
        x0, x1 = int(starts[s0]), int(starts[s1 - 1]) + 1
        at = np.arange(x0, x1 + w - 1)
        m = times[at]
        p = np.repeat(at, m)
        k = np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
        row = k + np.repeat(low[at], m)
        q = rows[row]
        d = q - p
        # the places of the token before and after q, as offsets
        far = np.int64(1) << 40
        before = np.where(k > 0, rows[row - 1] - p, -far)
        after = np.where(k < np.repeat(m, m) - 1, rows[np.minimum(row + 1, len(rows) - 1)] - p, far)
        if not len(d):
            continue
        order = np.argsort(d, kind="stable")
        p, q, d, before, after = p[order], q[order], d[order], before[order], after[order]
        seen, often = np.unique(d, return_counts=True)
        offsets = seen[often >= config.shared // 2] if main else _offsets(seen, config)
        first, last = np.searchsorted(d, offsets - w + 1, "left"), np.searchsorted(d, offsets + w - 1, "right")
        enough = last - first >= config.shared
        offsets, first, size = offsets[enough], first[enough], (last - first)[enough]
        for o0, o1 in _slices(size + (x1 - x0), PART):
            o, number = offsets[o0:o1], size[o0:o1]
            of = np.repeat(np.arange(len(o)), number)
            r = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first[o0:o1], number)
            counts_here = (o[of] >= before[r]) & (o[of] < after[r])  # q is the nearest on its side
            of, r = of[counts_here], r[counts_here]
            shift, place, base = d[r] - o[of], p[r], q[r] - o[of]
            begin = np.where(shift <= 0, place - w + 1, base - w + 1)
            end = np.where(shift <= 0, base, place)
            # tokens that are found on both sides count once
            twice = (shift <= 0) & (after[r] - d[r] < w)
            b2, e2 = (after[r] + place - o[of] - w + 1)[twice], base[twice]
            width = x1 - x0 + 1
            change = np.zeros(len(o) * width, np.int64)
            for f, b, e, sign in ((of, begin, end, 1), (of[twice], b2, e2, -1)):
                b, e = np.clip(b, x0, x1), np.clip(e + 1, x0, x1)
                some = e > b
                change += sign * np.bincount(f[some] * width + b[some] - x0, minlength=len(change))
                change -= sign * np.bincount(f[some] * width + e[some] - x0, minlength=len(change))
            full = np.cumsum(change.reshape(len(o), width), axis=1)[:, :-1] >= config.shared
            f, x = np.nonzero(full & xs[x0:x1])
            x, y = x + x0, (x + x0) + o[f]
            fits = (y >= 0) & (y < len(ys))
            x, y = x[fits], y[fits]
            x, y = x[ys[y]], y[ys[y]]
            if len(x) and not (one.distinct and other.distinct):
                new = ~(hit_x[x] & hit_y[y])
                x, y = x[new], y[new]
                near = ~one.repeating[x]  # if the window's tokens are distinct, the other holds as many at least
                near[~near] = _both(one, other, x[~near], y[~near], config)
                x, y = x[near], y[near]
            hit_x[x] = True
            hit_y[y] = True


def _each(one: Windows, other: Windows, xs: np.ndarray, ys: np.ndarray, hit_x: np.ndarray, hit_y: np.ndarray, config: Config) -> bool:
    """As ``_sweep``, each window of ``xs`` being held against all of ``ys``; False if that is too much."""
    w = config.window
    x, there = np.flatnonzero(xs), _covered(ys, w)
    low = np.searchsorted(one.sorted, other.tokens[there], "left")
    times = np.searchsorted(one.sorted, other.tokens[there], "right") - low
    there, low, times = there[times > 0], low[times > 0], times[times > 0]
    most = int(times.max(initial=0))
    if len(x) * (len(there) * most + len(ys)) > EACH:
        return False
    inside = np.zeros((len(x), len(ys) + 1), np.int32)
    for k in range(most):
        some = times > k
        p = one.order[low[some] + k]
        inside[:, there[some] + 1] |= (p >= x[:, None]) & (p < x[:, None] + w)
    inside = np.cumsum(inside, axis=1, dtype=np.int32)
    f, y = np.nonzero((inside[:, w:] - inside[:, :-w] >= config.shared) & ys[: len(ys) - w + 1])
    if len(f):
        near = ~other.repeating[y]
        near[~near] = _both(other, one, y[~near], x[f[~near]], config)
        hit_x[x[f[near]]] = True
        hit_y[y[near]] = True
    return True


def _searched(one: Windows, other: Windows, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Near windows, in ``one`` and in ``other``, of texts of any size: main offsets first, then what is left."""
    xs, ys = _wanted(one, other, config), _wanted(other, one, config)
    hit_x, hit_y = np.zeros(len(xs), bool), np.zeros(len(ys), bool)
    if xs.any() and ys.any():
        (a, s), (b, t) = one.ruled(config), other.ruled(config)
        hit_x[a[np.isin(s, t)]] = True  # each of these is near each that the same token rules
        hit_y[b[np.isin(t, s)]] = True
        if (left := xs & ~hit_x).any() and (beside := ys & ~hit_y).any():
            _sweep(one, other, left, beside, hit_x, hit_y, config, main=True)
        if (left := xs & ~hit_x).any() and not _each(one, other, left, ys, hit_x, hit_y, config):
            _sweep(one, other, left, ys, hit_x, hit_y, config)
        if (left := ys & ~hit_y).any() and not _each(other, one, left, xs, hit_y, hit_x, config):
            _sweep(other, one, left, xs, hit_y, hit_x, config)
    return one.alike(np.flatnonzero(hit_x)), other.alike(np.flatnonzero(hit_y))


#: Of a pair which windows may be near others, and which are: in one text, in the other, and again.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _of_distinct(pairs: list[tuple[Windows, Windows]], config: Config) -> Iterator[Found]:
    """Near windows of pairs of texts without repeated tokens, all pairs together.

    A token has one place in the other text at most.  The window y holds ``shared`` of a window's tokens if two of their
    places, ``shared`` - 1 apart when these are sorted, both lie in it; so y lies in one of a few intervals.
    """
    w, shared = config.window, config.shared
    size_x, size_y = (np.array([len(p[k].tokens) for p in pairs]) for k in (0, 1))
    end_x, end_y = np.cumsum(size_x), np.cumsum(size_y)
    begin_x, begin_y = end_x - size_x, end_y - size_y
    tokens = np.concatenate([p[1].tokens for p in pairs])
    place = np.empty(len(tokens), np.int64)  # in the other text, -1 for none
    k = 0
    for _, same in groupby(pairs, lambda p: id(p[0])):
        one, to = pairs[k][0], k + sum(1 for _ in same)
        asked = tokens[begin_y[k] : end_y[to - 1]]
        at = np.minimum(np.searchsorted(one.sorted, asked), len(one.sorted) - 1)
        place[begin_y[k] : end_y[to - 1]] = np.where(one.sorted[at] == asked, one.order[at], -1)
        k = to
    met = np.flatnonzero(place >= 0)
    at = np.full(end_x[-1], -1)
    at[place[met] + np.repeat(begin_x, size_y)[met]] = met
    q = at[at >= 0]  # places in the other text, by place in this one

    def wanted(found: np.ndarray, ends: np.ndarray, size: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.concatenate([[0], np.cumsum(found)])
        full = np.zeros(len(found), bool)
        full[: len(found) - w + 1] = sums[w:] - sums[:-w] >= shared
        return full & np.concatenate([p[side].looked for p in pairs]) & (np.arange(w, len(found) + w) <= np.repeat(ends, size)), sums

    xs, sums = wanted(at >= 0, end_x, size_x, 0)
    ys, _ = wanted(place >= 0, end_y, size_y, 1)
    starts = np.flatnonzero(xs)
    first, last = sums[starts], sums[starts + w] - 1
    least = np.repeat(begin_y, size_x)[starts]
    held = np.concatenate([[0], np.cumsum(ys)])
    change, near = np.zeros(len(ys) + 1, np.int64), np.zeros(len(starts), bool)

    def mark(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        low = np.maximum(low, least[rows])
        some = low <= high
        rows, low, high = rows[some], low[some], high[some]
        some = held[high + 1] > held[low]
        near[rows[some]] = True
        np.add(change, np.bincount(low[some], minlength=len(change)) - np.bincount(high[some] + 1, minlength=len(change)), out=change)

    falls = np.concatenate([[0], np.cumsum(q[1:] < q[:-1])])
    rising = falls[first] == falls[last]
    sorted_, mixed = np.flatnonzero(rising), np.flatnonzero(~rising)
    for k in range(w - shared + 1):
        rows = sorted_[first[sorted_] + k + shared - 1 <= last[sorted_]]
        mark(rows, q[first[rows] + k + shared - 1] - w + 1, q[first[rows] + k])
    none = len(ys) + 2 * w  # sorted behind all places
    for a in range(0, len(mixed), 1 << 13):
        rows = mixed[a : a + (1 << 13)]
        of = first[rows, None] + np.arange(w)
        places = np.sort(np.where(of <= last[rows, None], q[np.minimum(of, len(q) - 1)], none), axis=1)
        for k in range(w - shared + 1):
            mark(rows, places[:, k + shared - 1] - w + 1, places[:, k])
    hit_x = np.zeros(len(xs), bool)
    hit_x[starts[near]] = True
    hit_y = ys & (np.cumsum(change)[:-1] > 0)
    for a, b, c, d in zip(begin_x.tolist(), end_x.tolist(), begin_y.tolist(), end_y.tolist()):
        yield xs[a:b], ys[c:d], hit_x[a:b], hit_y[c:d]


def _of_few(one: Windows, other: Windows, mine: tuple, theirs: tuple, config: Config) -> Found:
    """Near windows of two texts of which few differ in content: each is held against each, by the counts of their tokens."""
    (tokens, x, n), (asked, y, m) = mine, theirs
    at = np.minimum(np.searchsorted(tokens, asked), len(tokens) - 1)
    some = tokens[at] == asked
    n, m = n[:, at[some]], m[:, some]
    near = (n @ (m > 0).T.astype(np.float32) >= config.shared) & ((n > 0).astype(np.float32) @ m.T >= config.shared)
    xs, ys, hit_x, hit_y = (np.zeros(len(t.tokens), bool) for t in (one, other, one, other))
    xs[x], ys[y], hit_x[x], hit_y[y] = n.sum(axis=1) >= config.shared, m.sum(axis=1) >= config.shared, near.any(axis=1), near.any(axis=0)
    return xs, ys, hit_x, hit_y


def tested(tests: list[tuple[Windows, Windows, np.ndarray | None, np.ndarray | None]], config: Config) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Of each pair the starts of near windows in both texts, all that there are; None if there are none.

    With windows that hold new words a pair that has near windows, but may not have them there, is given without starts.
    """
    none = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(tests)

    def told(k: int, xs: np.ndarray, ys: np.ndarray, hit_x: np.ndarray, hit_y: np.ndarray) -> None:
        one, other, new_one, new_other = tests[k]
        if hit_x.any():
            plain = new_one is not None and not ((xs & new_one).any() or (ys & new_other).any())
            out[k] = (none, none) if plain else (one.alike(np.flatnonzero(hit_x)), other.alike(np.flatnonzero(hit_y)))

    plain = np.array([k for k, (one, other, *_) in enumerate(tests) if one.distinct and other.distinct], np.int64)
    for a, b in _slices(np.array([len(tests[k][0].tokens) + len(tests[k][1].tokens) for k in plain], np.int64), PART):
        for k, found in zip(plain[a:b].tolist(), _of_distinct([tests[k][:2] for k in plain[a:b]], config)):
            told(k, *found)
    before, mine = None, None
    for k, (one, other, new_one, new_other) in enumerate(tests):
        if one.distinct and other.distinct:
            continue
        n, m = int(np.count_nonzero(one.looked)), int(np.count_nonzero(other.looked))
        if max(n * one.known, m * other.known, n * m) <= FEW_WINDOWS and n * m * min(one.known, other.known) <= FEW_WINDOWS << 6:
            if one is not before:
                before, mine = one, one.counted()
            told(k, *_of_few(one, other, mine, other.counted(), config))
        elif new_one is not None and not may_tell(one, other, new_one, new_other, config):
            out[k] = (none, none) if linked(one, other, config) else None
        else:
            found = _searched(one, other, config)
            out[k] = found if len(found[0]) else None
    return out


def passages(one: Windows, other: Windows, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Starts of near windows, in ``one`` and in ``other``: all that there are."""
    return tested([(one, other, None, None)], config)[0] or (np.zeros(0, np.int64), np.zeros(0, np.int64))


def outside(place: np.ndarray, found: list[dict] | None, config: Config) -> np.ndarray:
    """Which windows at the places hold a word that is in none of the spans, which lie in order and apart."""
    if not found:
        return np.ones(len(place), bool)
    first, end = np.array([s["first"] for s in found]), np.array([s["end"] for s in found])
    at = np.searchsorted(first, place, "right") - 1
    return (at < 0) | (end[at] < place + config.window + config.n - 1)


def may_tell(one: Windows, other: Windows, new_one: np.ndarray, new_other: np.ndarray, config: Config) -> bool:
    """May a window with new words be near one of the other text?"""
    xs, ys = _wanted(one, other, config), _wanted(other, one, config)
    return bool(((xs & new_one).any() and ys.any()) or ((ys & new_other).any() and xs.any()))


def linked(one: Windows, other: Windows, config: Config) -> bool:
    """Are there near windows?  Equal ones and a few others are tried before all are looked for."""
    if not (one.distinct or other.distinct) and np.isin(one.kinds, other.kinds, assume_unique=True).any():
        return True
    xs, ys = _wanted(one, other, config), _wanted(other, one, config)
    if not (xs.any() and ys.any()):
        return False
    if np.isin(one.ruled(config)[1], other.ruled(config)[1]).any():
        return True
    at, few, hit_x = np.flatnonzero(xs), np.zeros(len(xs), bool), np.zeros(len(xs), bool)
    few[at[:: -(-len(at) // TRIED)]] = True
    if _each(one, other, few, ys, hit_x, np.zeros(len(ys), bool), config) and hit_x.any():
        return True
    return len(_searched(one, other, config)[0]) > 0


def spans(starts: np.ndarray, config: Config) -> list[dict[str, int]]:
    """Word spans of windows that begin there; those that meet are one."""
    length = config.window + config.n - 1
    cut = np.flatnonzero(starts[1:] - starts[:-1] > length)
    if not len(cut):
        return [{"first": int(starts[0]), "end": int(starts[-1]) + length}]
    firsts, lasts = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
    return [{"first": a, "end": b} for a, b in zip(firsts.tolist(), (lasts + length).tolist())]


_SPANS = "u long, v long, u_spans array<struct<first:long,end:long>>, v_spans array<struct<first:long,end:long>>"


def verified(pairs: DataFrame, texts: DataFrame, config: Config, known: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (u, v) that share a passage, with its spans on both sides; texts has doc, tokens, place, valid.

    A text u is sent once along with ``BESIDE`` of its partners and is taken apart once for them.  With ``known`` (doc, s,
    class, later) a pair of one class is given without spans if its v is known to be a later one and none of its windows
    that may be near the other text holds words outside s.
    """
    ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "passage-ids")
    held = texts.join(_few(ids), texts["doc"] == ids["id"], "left_semi").select("doc", "tokens", "place", "valid")
    columns, chosen = ["tokens", "place", "valid"], known is not None
    if known is not None:
        held = held.join(known.select("doc", "s", "class", "later"), "doc", "left").withColumn("class", F.coalesce("class", "doc"))
        columns += ["s", "class", "later"]
    sizes = stored(pairs.groupBy("u").agg(F.ceil(F.count("*") / BESIDE).cast("int").alias("parts")), "passage-hubs")
    dealt = pairs.join(sizes, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    hubs = sizes.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hubs = hubs.join(held, hubs["u"] == held["doc"]).select("u", "part", F.lit(None).cast("long").alias("v"), *columns)
    others = dealt.join(held, dealt["v"] == held["doc"]).select("u", "part", "v", *columns)
    rows = hubs.unionByName(others).repartition(_parts(pairs), "u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("u_spans", span), ("v_spans", span)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hub, at = [], None
        for batch in batches:
            asked, tests, out = [], [], []
            for k, (u, part, v) in enumerate(zip(batch["u"].to_pylist(), batch["part"].to_pylist(), batch["v"].to_pylist())):
                place = np.frombuffer(batch["place"][k].as_py(), np.int32).astype(np.int64)
                this = Windows(np.frombuffer(batch["tokens"][k].as_py(), np.uint64), np.frombuffer(batch["valid"][k].as_py(), bool), config.window)
                new = own = later = None
                if chosen:
                    new = this.standing(outside(place, batch["s"][k].as_py(), config))
                    own, later = batch["class"][k].as_py(), batch["later"][k].as_py()
                if (u, part) != at:
                    at, hub = (u, part), []
                if v is None:
                    hub.append((this, place, new, own))
                    continue
                for one, one_place, one_new, one_own in hub:
                    asked.append((u, v, one_place, place))
                    tests.append((one, this, one_new, new) if chosen and own == one_own and later else (one, this, None, None))
            for (u, v, one_place, place), found in zip(asked, tested(tests, config)):
                if found is not None:
                    out.append({"u": u, "v": v} | {c: spans(x[y], config) if len(y) else [] for c, x, y in (("u_spans", one_place, found[0]), ("v_spans", place, found[1]))})
            yield pa.RecordBatch.from_pylist(out, kind)
        trim()

    return stored(rows.mapInArrow(verify, _SPANS), "passage-links")


def each_side(links: DataFrame) -> DataFrame:
    """id, first, end (words): the distinct spans of every document that has a link."""
    side = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("u_spans").alias("s")), F.struct(F.col("v").alias("id"), F.col("v_spans").alias("s"))))
    # a hub holds few distinct spans, however many documents share them
    lists = links.select(side.alias("l")).select("l.id", "l.s").distinct()
    return lists.select("id", F.explode("s").alias("s")).select("id", "s.first", "s.end").distinct()


def joined_spans(links: DataFrame) -> DataFrame:
    """id, s: the words of its spans, those that meet being one."""
    held = each_side(links).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("s"))
    start = F.array().cast("array<struct<first:long,end:long>>")

    def step(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when(F.size(done) == 0, F.array(s)).when(s["first"] <= last["end"], joined).otherwise(F.concat(done, F.array(s)))

    return held.select("id", F.aggregate("s", start, step).alias("s"))


class Search:
    """The links of a table of texts (doc_id, text), of which no two are equal.

    A pair of texts that hold a key is tested, or it could tell nothing new: the words of the windows with that key are
    found on both sides, the two have one class, and the later one holds a passage of an earlier one.
    """

    def __init__(self, texts: DataFrame, config: Config) -> None:
        self.config = config
        self.texts = stored(holders(stored(reduced(texts, config), "passage-parts"), config), "passage-windows")
        held = self.texts.select("doc", F.explode("held").alias("h")).select("h.key", "doc", "h.first", "h.end", "h.n", "h.bits")
        out = _candidates(held.select("key", "doc", "n", "bits"), config, lambda t, bits, ends, shared: first_pairs(t["doc"], bits, t["n"], ends, shared))
        out = stored(out, "passage-pairs")
        self.tested = out.where("key is null").select("u", "v")
        self.links = verified(self.tested, self.texts, config)
        left, best = out.where("key is not null").select("key"), PIVOTS
        while not left.isEmpty():
            out = stored(self._further(held.join(_few(left), "key", "left_semi"), best), "passage-further")
            pairs = stored(out.where("key is null").select("u", "v").join(self.tested, ["u", "v"], "left_anti"), "passage-untested")
            self.links = self.links.unionByName(verified(pairs, self.texts, config, self.known))
            self.tested = self.tested.unionByName(pairs)
            left, best = out.where("key is not null").select("key"), best * MORE_PIVOTS

    def _further(self, rows: DataFrame, best: int) -> DataFrame:
        """Pairs of the rows (key, doc, first, end, n, bits) that may tell something that is not known yet."""
        found = components(self.links.select("u", "v"))
        later = self.links.select(F.col("v").alias("doc")).distinct().withColumn("later", F.lit(True))
        known = joined_spans(self.links).join(found, F.col("id") == F.col("node"), "left")
        known = known.select(F.col("id").alias("doc"), "s", F.coalesce("component", "id").alias("class")).join(later, "doc", "left")
        known = self.known = stored(known, "passage-known")
        inside = F.exists("s", lambda s: (s["first"] <= F.col("first")) & (s["end"] >= F.col("end")))
        rows = rows.join(known, "doc", "left").select("key", "doc", "n", "bits", F.coalesce(inside, F.lit(False)).alias("settled"), F.coalesce("later", F.lit(False)).alias("later"), F.coalesce("class", "doc").alias("class"))
        state = rows.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.min("settled").alias("settled"), F.min("doc").alias("first"), F.max(F.when(~F.col("later"), F.col("doc"))).alias("last"))
        open_ = state.where("a < b or not settled or last > first").select("key")
        return _candidates(rows.join(open_, "key", "left_semi"), self.config, lambda t, bits, ends, shared: further_pairs(t, bits, ends, shared, best))


def equal_texts(texts: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Of texts that are long enough and equal but for A-Z each further one with the first: first, doc_id, n_words.

    And the ids of those whose rows all have that one text: they need no search of their own.
    """
    digest = F.md5(normalised(F.col("text"))).alias("digest")
    marked = stored(texts.where("doc_id is not null").select("doc_id", digest), "passage-digests")
    several = marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    several = _few(stored(several.select("digest", "first"), "passage-equal"))
    met = stored(marked.join(several, "digest").where("doc_id <> first").select("digest", "first", "doc_id").distinct(), "passage-met")
    firsts = met.select(F.col("first").alias("doc_id")).distinct()
    sizes = texts.join(_few(firsts), "doc_id", "left_semi").select(F.col("doc_id").alias("first"), digest, words(F.col("text")).alias("n_words")).distinct()
    long = sizes.where(F.col("n_words") >= config.window + config.n - 1)
    copies = stored(met.join(long, ["first", "digest"]).select("first", "doc_id", "n_words"), "passage-copies")
    ids = copies.select("doc_id").distinct()
    plain = marked.join(_few(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a = b")
    return copies, stored(plain.select("doc_id"), "passage-plain")


class Passages:
    """``spans`` of every document that holds a repeated passage, ``links`` between them, ``decisions`` for all."""

    def __init__(self, docs: DataFrame, config: Config | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        config = config or Config()
        texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
        self.texts = texts
        copies, plain = equal_texts(texts, config)
        apart = texts.join(_few(plain), "doc_id", "left_anti")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))
        same = copies.select(F.col("first").alias("u"), F.col("doc_id").alias("v"), whole.alias("u_spans"), whole.alias("v_spans"))
        self.links = Search(apart, config).links.unionByName(same)

    def spans(self) -> DataFrame:
        """doc_id, partner, first, end (words): a row for each passage of a pair, from both sides.

        Of tested pairs, but for those that hold only words that pairs before them were found to share.
        """
        one = self.links.select(F.col("u").alias("doc_id"), F.col("v").alias("partner"), F.explode("u_spans").alias("s"))
        other = self.links.select(F.col("v").alias("doc_id"), F.col("u").alias("partner"), F.explode("v_spans").alias("s"))
        return one.unionByName(other).select("doc_id", "partner", "s.first", "s.end")

    def decisions(self) -> DataFrame:
        """A row for each document: class_id (least id reachable by links), partners, n_links, passages, kept.

        ``partners`` are the earlier documents that it was linked to; ``n_links`` counts links both ways.
        ``passages`` are the joined word spans, first:end.  A document is kept if it holds no passage that an
        earlier one holds.
        """
        later = self.links.groupBy(F.col("v").alias("id")).agg(F.sort_array(F.collect_set("u")).alias("partners"))
        count = self.links.select("u", "v").distinct().select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
        held = joined_spans(self.links)
        text = F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["first"], s["end"])), ",")
        words = F.aggregate("s", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
        found = components(self.links.select("u", "v"))
        marked = held.select("id", text.alias("passages"), words.alias("n_words")).join(count, "id").join(later, "id", "left").join(found, F.col("id") == F.col("node"), "left")
        marked = marked.select(F.col("id").alias("__id"), F.coalesce("component", "id").alias("class"), "partners", "n_links", "passages", "n_words")
        every = self.texts.select("doc_id").join(marked, F.col("doc_id") == F.col("__id"), "left")
        return every.select(
            "doc_id",
            F.coalesce("class", "doc_id").alias("class_id"),
            F.coalesce("partners", F.array().cast("array<long>")).alias("partners"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("passages", F.lit("")).alias("passages"),
            F.coalesce("n_words", F.lit(0)).cast("long").alias("n_repeated_words"),
            F.col("partners").isNull().alias("kept"),
        )
