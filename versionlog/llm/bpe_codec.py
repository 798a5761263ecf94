"""BPE encoding and decoding by speculation and verification.

A longest-match automaton proposes tokens for all new words of a batch at once.
A proposal is right if each token encodes alone as itself and every adjacent
pair is compatible: merging the two together keeps the border between them.
The pair test runs over all pairs of a batch as arrays; only words that fail it
are merged exactly.

Why pairs suffice: look at the first merge of the exact process that crosses a
border.  Until then both neighbours went through the very steps that they go
through when the pair is encoded by itself, so that merge would cross the
border there too.

Defined results: null and empty texts encode to no ids and decode to an empty
text; special strings in a text take their own ids; no truncation, padding or
added tokens; rows keep their number and other columns pass through, except
input columns named like the outputs, which give way; an empty table gives an
empty table.  Decoding joins token strings with one space, as a vocabulary
without a decoder does; null ids decode to an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from . import bpe
from ._io import put, text_of
from .bpe import Shared

#: Memory, in bytes, for the words of which a worker remembers the encoding; twice as much at most.
MEMO_BYTES = 24 << 20
#: What a remembered word takes besides its characters and ids.
ENTRY_BYTES = 200
#: Longer words, in bytes, are merged one by one with a heap.
LONG_WORD = 64
_NEVER = np.int64(1) << 40


class Memo(dict):
    """A mapping in two generations: what is asked for stays, the rest goes when the young one is full."""

    def __init__(self, most: int) -> None:
        self.most, self.size, self.old = most, 0, {}

    def add(self, keys: list[str], values: list[bytes]) -> None:
        self.update(zip(keys, values))
        self.size += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + sum(map(len, values))

    def renew(self) -> None:
        if self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0

    def unknown(self, keys: set) -> list:
        """Of keys that the young generation lacks, those that the old one lacks too; the others become young again."""
        again = [k for k in keys if k in self.old]
        self.add(again, [self.old[k] for k in again])
        return list(keys.difference(again))


class Codec:
    """Ids are kept as little-endian unsigned 32-bit bytes, so that texts are joined, not built up."""

    def __init__(self, t: bpe.Tables, memo_bytes: int = MEMO_BYTES) -> None:
        self.t, self.pre = t, bpe.PreTokens(t)
        self.words = Memo(memo_bytes)
        self.first, self.last = np.array(t.first, np.int64), np.array(t.last, np.int64)
        self.made = np.array([t.merges[k >> 32, k & 0xFFFFFFFF][1] for k in t.pair_key.tolist()], np.int64)
        # merges of two bytes, the second one ending its word or not: what all merging begins with
        pairs = self.pair(np.repeat(self.first, 512), np.tile(np.concatenate([self.first, self.last]), 256))
        self.byte_rank, self.byte_made = (x.reshape(256, 512) for x in pairs)
        self.special = {i: np.array([i], "<u4").tobytes() for i in t.special.values()}
        # a word is spelled with a character for each byte, another one for the byte that ends it
        self.trie = ahocorasick.Automaton()
        chars = {s: chr(b) for b, s in enumerate(t.first)} | {s: chr(256 + b) for b, s in enumerate(t.last)}
        for i, symbols in enumerate(t.spelled):
            if symbols and t.alone[i]:
                self.trie.add_word("".join(map(chars.__getitem__, symbols)), (i, len(symbols)))
        self.trie.make_automaton()

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of each pair; without one the rank is _NEVER."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.t.pair_key, key), len(self.t.pair_key) - 1)
        return np.where(self.t.pair_key[at] == key, self.t.pair_rank[at], _NEVER), self.made[at]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does encoding the two tokens together keep them apart?

        Both derivations are undone from their last merge on.  While the tokens
        at the border are as they stand, a merge across it would come first if
        its rank is below that of the next merge in time; a tie goes to the left.
        """
        rank, left, right = self.t.rank, self.t.left, self.t.right
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, before = a.astype(np.int64), b.astype(np.int64), np.full(len(a), _NEVER)
        while len(live):
            crossing = self.pair(a, b)[0] < before
            ok[live[crossing]] = False
            ra, rb = rank[a], rank[b]
            on = ~crossing & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            undo_right = rb >= ra  # of equal ranks the right one was merged last
            before = np.where(undo_right, rb + 1, ra)
            a, b = np.where(undo_right, a, right[a]), np.where(undo_right, left[b], b)
        return ok

    def speculate(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match ids of all words in a row, and where each word's begin; the last place is the end."""
        found = list(self.trie.iter_long("".join(spelled)))
        ids = np.array([v[0] for _, v in found], np.int64)
        ends = np.cumsum(np.array([v[1] for _, v in found], np.int64))
        word_ends = np.cumsum(np.array(list(map(len, spelled)), np.int64))
        if len(ends) == 0 or ends[-1] != word_ends[-1]:
            raise ValueError("the vocabulary lacks single bytes")
        return ids, np.concatenate([[0], np.searchsorted(ends, word_ends, "right")])

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words at once: each step does the next merge of every word."""
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        out: list[bytes] = [b""] * len(words)
        for k in long:
            out[k] = np.array(bpe.merge(bpe.spell(words[k], self.t), self.t.merges)[0], "<u4").tobytes()
        names = np.array([k for k, w in enumerate(words) if len(w) <= LONG_WORD], np.int64)
        size = np.array([len(words[k]) for k in names.tolist()], np.int64)
        raw = np.frombuffer(b"".join([words[k] for k in names.tolist()]), np.uint8)
        end = np.zeros(len(raw), bool)
        end[np.cumsum(size) - 1] = True
        ids = np.where(end, self.last[raw], self.first[raw])
        after = np.append(raw[1:] + 256 * end[1:].astype(np.int64), 0)[: len(raw)]
        rank, made = self.byte_rank[raw, after], self.byte_made[raw, after]
        rank[end] = _NEVER
        while len(names):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            done = least == _NEVER
            if done.any():
                stay = np.repeat(~done, size)
                flat, ends = ids[~stay].astype("<u4").tobytes(), (4 * np.cumsum(size[done])).tolist()
                for k, a, b in zip(names[done].tolist(), [0, *ends], ends):
                    out[k] = flat[a:b]
                names, size, least = names[~done], size[~done], least[~done]
                ids, rank, made = ids[stay], rank[stay], made[stay]
                if not len(names):
                    break
                start = np.cumsum(size) - size
            word = np.repeat(np.arange(len(names)), size)
            at = np.flatnonzero(rank == least[word])
            at = at[np.diff(word[at], prepend=-1) > 0]  # the leftmost of each word
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank, made, size = ids[keep], rank[keep], made[keep], size - 1
            at -= np.arange(len(at))  # one place went in every word before
            start = np.cumsum(size) - size
            ends = at == start + size - 1
            again = np.concatenate([at[~ends], at[at > start] - 1])
            rank[at[ends]] = _NEVER
            rank[again], made[again] = self.pair(ids[again], ids[again + 1])
        return out

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        ids, at = self.speculate([r[:-1].decode("latin-1") + chr(256 + r[-1]) for r in raw])
        word = np.repeat(np.arange(len(words)), np.diff(at))
        inside = word[1:] == word[:-1]
        pairs_ok = self.compatible(ids[:-1][inside], ids[1:][inside]) if self.t.nested else np.zeros(inside.sum(), bool)
        good = np.ones(len(words), bool)
        good[word[1:][inside][~pairs_ok]] = False
        flat, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
        self.words.add(words, [flat[i:j] for i, j in zip(at, at[1:])])
        bad = np.flatnonzero(~good).tolist()
        self.words.update(zip([words[k] for k in bad], self.merge_all([raw[k] for k in bad])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: those of its pre-tokens in a row."""
        split = [self.pre(x) for x in texts]
        memo = self.words
        lacking = set().union(*split).difference(memo)
        if lacking:
            memo.update((i, self.special[i]) for i in lacking.intersection(self.special))
            if new := memo.unknown(lacking.difference(self.special)):
                self.learn(new)
        out = [np.frombuffer(b"".join(map(memo.__getitem__, ws)), "<u4") for ws in split]
        memo.renew()
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space."""
        return " ".join(map(self.t.tokens.__getitem__, ids))


def _slices(batch: pa.Array, most: int = 250) -> Iterator[list]:
    for k in range(0, len(batch), most):
        yield batch.slice(k, most).to_pylist()


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every whole text as an array."""
    shared = Shared.of(df, tokenizer)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.held(Codec)
        for batch in batches:
            rows = [ids for texts in _slices(batch) for ids in codec.encode(texts)]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, "<u4"), *rows]).astype(np.int32))

    return put(df, {out: F.arrow_udf(run, "array<int>", ArrowUDFType.SCALAR_ITER)(text_of(df, text_col))})


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that an array of ids decodes to."""
    shared = Shared.of(df, tokenizer)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.held(Codec)
        for batch in batches:
            yield pa.array([codec.decode(ids or []) for ids in batch.to_pylist()], pa.string())

    return put(df, {out: F.arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)(df[ids_col])})


def round_trip(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The digests are of the decimal ids joined by one space and of the decoded text.
    """
    shared = Shared.of(df, tokenizer)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.held(Codec)
        decimal = list(map(str, range(len(codec.t.tokens))))
        for batch in batches:
            rows = [
                (len(ids), hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                for texts in _slices(batch)
                for ids in map(np.ndarray.tolist, codec.encode(texts))
            ]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], fields=list(kind))

    udf = F.arrow_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string", ArrowUDFType.SCALAR_ITER)
    done = df.withColumn("__trip", udf(text_of(df, text_col)))
    return put(done, {f.name: done["__trip"][f.name] for f in kind}).drop("__trip")
