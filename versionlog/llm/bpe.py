"""Byte-level BPE with word ends: pre-tokens, exact merges, offline proofs.

A vocabulary file is read once on the driver; `tables` proves there which
tokens encode alone as themselves and how each is derived.  The tables' size is
fixed by the vocabulary, so they are broadcast.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ._io import KEPT, forget

#: Characters that the fast path takes: up to U+017F without U+0130, whose lower case is two characters.
_SLOW = re.compile("[^\x00-įı-ſ]")
_FAST = [chr(c) for c in range(0x180)]
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _class(prefix: str) -> str:
    return "".join(re.escape(c) for c in _FAST if unicodedata.category(c)[0] == prefix)


_L, _N = _class("L"), _class("N")
_WORD = re.compile(rf"[{_L}]+|[{_N}]|'(?:[stmd]|re|ve|ll)|[^{re.escape(_SPACE)}{_L}{_N}]+")


#: What these modules do in their own code; a file that asks for anything else is refused.
#: They must equal what the file says.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUPPORTED = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
SUPPORTED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
SUPPORTED_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def refuse_others(file: dict) -> None:
    """Raise unless the file's settings are those that this module follows; another file would give wrong ids silently."""
    asked = [(k, file.get(k), v) for k, v in SUPPORTED.items()] + [(k, file["model"].get(k), v) for k, v in SUPPORTED_MODEL.items()]
    asked += [(k, t.get(k), v) for t in file["added_tokens"] for k, v in SUPPORTED_ADDED.items()]
    if odd := [k for k, got, want in asked if got != want]:
        raise ValueError(f"a vocabulary with other settings: {', '.join(dict.fromkeys(odd))}")
    if lacking := [c for c in byte_chars() if c not in file["model"]["vocab"] or f"{c}</w>" not in file["model"]["vocab"]]:
        raise ValueError(f"a vocabulary without {len(lacking)} of the single bytes")


@lru_cache(1)
def byte_chars() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass
class Tables:
    """What is known of a vocabulary before any text is read."""

    blob: bytes
    tokens: list[str]  # by id
    special: dict[str, int]
    first: list[int]  # id of each byte inside a word
    last: list[int]  # id of each byte that ends a word
    merges: dict[tuple[int, int], tuple[int, int]]  # pair -> (rank, id)
    spelled: list[list[int] | None]  # byte symbols of each token
    alone: np.ndarray  # does the token's own text encode as this token?
    rank: np.ndarray  # rank of the merge that makes the token; -1 for a byte
    left: np.ndarray  # its halves; the token itself for a byte
    right: np.ndarray
    pair_key: np.ndarray  # sorted left << 32 | right
    pair_rank: np.ndarray
    nested: bool  # every merge joins tokens made by earlier merges

    def words(self) -> dict[str, int]:
        """Proven shortcut: pre-tokens that are one token."""
        back = {c: b for b, c in enumerate(byte_chars())}
        found = {}
        for i, token in enumerate(self.tokens):
            if self.alone[i] and token.endswith("</w>"):
                try:
                    found[bytes(back[c] for c in token[:-4]).decode()] = i
                except (KeyError, UnicodeDecodeError):
                    continue
        return found


def merge(symbols: list[int], merges: dict) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Exact merging: lowest rank first, then leftmost.  Returns ids and the merges done.

    Short words scan for the best pair; long ones keep a heap, so time stays near linear.
    """
    done = []
    if len(symbols) <= 40:
        symbols = list(symbols)
        while len(symbols) > 1:
            best = None
            for k in range(len(symbols) - 1):
                m = merges.get((symbols[k], symbols[k + 1]))
                if m and (best is None or m[0] < best[0]):
                    best, at = m, k
            if best is None:
                break
            done.append((symbols[at], symbols[at + 1], best[0]))
            symbols[at : at + 2] = [best[1]]
        return symbols, done
    ids, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap = [(m[0], k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (m := merges.get((ids[k], ids[k + 1])))]
    heapq.heapify(heap)
    while heap:
        rank, k, a, b = heapq.heappop(heap)
        n = after[k]
        if ids[k] != a or n >= len(ids) or ids[n] != b:
            continue
        done.append((a, b, rank))
        ids[k], ids[n] = merges[a, b][1], -1
        after[k] = after[n]
        if after[k] < len(ids):
            before[after[k]] = k
        for p, q in ((before[k], k), (k, after[k])):
            if p >= 0 and q < len(ids) and (m := merges.get((ids[p], ids[q]))):
                heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
    return [i for i in ids if i >= 0], done


def tables(blob: bytes) -> Tables:
    """Read a vocabulary and prove, token by token, what encodes alone."""
    model = json.loads(blob)
    refuse_others(model)
    vocab, pairs = model["model"]["vocab"], model["model"]["merges"]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for table in (vocab, special):
        for text, i in table.items():
            tokens[i] = text
    first = [vocab[c] for c in byte_chars()]
    last = [vocab[f"{c}</w>"] for c in byte_chars()]
    pairs = [p.split(" ") if isinstance(p, str) else p for p in pairs]
    merges = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
    back = {c: b for b, c in enumerate(byte_chars())}
    n = len(tokens)
    alone, rank = np.zeros(n, bool), np.full(n, -1, np.int64)
    left, right = np.arange(n), np.arange(n)
    spelled: list[list[int] | None] = [None] * n
    for token, i in vocab.items():
        stem, ends = (token[:-4], True) if token.endswith("</w>") and len(token) > 4 else (token, False)
        if any(c not in back for c in stem):
            continue
        raw = [back[c] for c in stem]
        symbols = [first[b] for b in raw]
        if ends:
            symbols[-1] = last[raw[-1]]
        spelled[i] = symbols
        got, done = merge(symbols, merges)
        alone[i] = got == [i]
        if alone[i] and done:
            left[i], right[i], rank[i] = done[-1]
    keys = np.array([a << 32 | b for a, b in merges], np.int64)
    ranks = np.array([m[0] for m in merges.values()], np.int64)
    order = np.argsort(keys)
    nested = all(max(rank[a], rank[b]) < m[0] for (a, b), m in merges.items())
    return Tables(blob, tokens, special, first, last, merges, spelled, alone, rank, left, right, keys[order], ranks[order], nested)


class PreTokens:
    """The library's pre-tokens of a text, as lower-case strings, and its special strings' ids."""

    def __init__(self, t: Tables) -> None:
        self.blob, self.special = t.blob, t.special
        names = sorted(t.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.back = {c: b for b, c in enumerate(byte_chars())}

    @cached_property
    def library(self) -> Tokenizer:
        """Only for characters beyond the fast path."""
        return Tokenizer.from_str(self.blob.decode())

    def plain(self, text: str) -> list[str]:
        if text.isascii() or not _SLOW.search(text):
            return _WORD.findall(text.lower())
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.back.__getitem__, w)).decode() for w, _ in shown]

    def __call__(self, text: str) -> list[str | int]:
        """Special strings come as their ids."""
        if "<" not in text or self.split is None:
            return self.plain(text)
        out: list[str | int] = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self.plain(part)
        return out


def spell(raw: bytes, t: Tables) -> list[int]:
    """Symbols of a word's bytes."""
    symbols = [t.first[b] for b in raw]
    symbols[-1] = t.last[raw[-1]]
    return symbols


@lru_cache(2)
def tables_of(path: str) -> Tables:
    """`tables` of a file, once per process."""
    with open(path, "rb") as f:
        return tables(f.read())


class Shared:
    """A broadcast vocabulary.  Workers keep what they build from it, until they build something else."""

    _sent: dict[tuple[str, str], Shared] = {}

    def __init__(self, key: tuple[str, str], broadcast) -> None:
        self.key, self.broadcast = key, broadcast

    @classmethod
    def of(cls, df: DataFrame, path: str) -> Shared:
        context = df.sparkSession.sparkContext
        key = (context.applicationId, path)
        if key not in cls._sent:
            cls._sent[key] = cls(key, context.broadcast(tables_of(path)))
        return cls._sent[key]

    def held(self, make):
        """``make(tables)``, made once per worker process."""
        key = (*self.key, make.__qualname__)
        if key not in KEPT:
            forget()
            KEPT[key] = make(self.broadcast.value)
        return KEPT[key]
