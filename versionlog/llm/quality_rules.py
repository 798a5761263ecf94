"""Quality rules: compression bands.

Zstandard ratios (compressed / plain bytes) of the whole text and of its fixed
chunks must lie in bands.  Low ratios mean repetition or a small stock of
tokens, high ones noise.  Short texts compress worse, so the limits of the whole
text depend on its length; those of chunks do not, as chunks have one length (the
last one ends with the text and overlaps the one before; a shorter text is measured whole).

Plain counts stand beside: words, symbols, repeated lines, repeated words.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; ratios of an empty text are 0; repeated rows are measured each; an
empty table gives an empty table; other columns pass through, and input columns
named like the outputs give way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ._io import put, text_of

#: Ratio limits from so many bytes on: (bytes, least, most).  The least ones lie
#: below what ordinary prose of four languages reaches at level 3; longer prose than
#: the test tables have goes on falling, so the limits from 25 kB on leave room.
LIMITS = (
    (0, 0.70, 9.0),
    (100, 0.51, 1.30),
    (200, 0.49, 1.00),
    (400, 0.50, 0.90),
    (800, 0.475, 0.80),
    (1600, 0.450, 0.75),
    (3200, 0.430, 0.72),
    (6400, 0.415, 0.70),
    (12800, 0.403, 0.70),
    (25600, 0.345, 0.70),
    (51200, 0.335, 0.70),
    (102400, 0.325, 0.70),
    (409600, 0.310, 0.70),
)
LEVEL = 3
CHUNK_BYTES = 2048
CHUNK_LIMITS = (0.45, 0.75)
#: So large a share of a text's chunks may lie outside the chunk limits.
CHUNK_SHARE = 0.1

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at exactly the six ASCII spaces
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        often = Counter(grams)
        inside = bytearray(len(words))
        for k, g in enumerate(grams):
            if often[g] > 1:
                inside[k : k + 3] = b"\1\1\1"
        repeated = sum(inside)
    return len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(raw.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def ratios(raw: bytes, press: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Of the whole and of its chunks.  All chunks have one length: the last one ends where the text ends."""
    if not raw:
        return 0.0, []
    whole = len(press.compress(raw)) / len(raw)
    starts = list(range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES))
    if starts and len(raw) % CHUNK_BYTES:
        starts.append(len(raw) - CHUNK_BYTES)
    return whole, [len(press.compress(raw[k : k + CHUNK_BYTES])) / CHUNK_BYTES for k in starts]


def in_bands(n_bytes: int, whole: float, chunks: list[float]) -> bool:
    _, least, most = max(x for x in LIMITS if x[0] <= n_bytes)
    low, high = CHUNK_LIMITS
    outside = sum(not low <= r <= high for r in chunks)
    return n_bytes > 0 and least <= whole <= most and outside <= CHUNK_SHARE * len(chunks)


_OUT = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("zstd_ratio", pa.float64()), ("least_chunk_ratio", pa.float64())]
)


def judge(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts, ``base_failed``, ``kept``, ``zstd_ratio`` and ``least_chunk_ratio`` (null without a full chunk)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for x in batch:
                text = x.as_py()
                c = counts(text)
                raw = text.encode()
                failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
                whole, chunks = ratios(raw, press)
                rows.append((*c, failed, not failed and in_bands(len(raw), whole, chunks), whole, min(chunks, default=None)))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)], fields=list(_OUT))

    kinds = ", ".join(f"{f.name} {({'int64': 'long', 'bool': 'boolean', 'double': 'double'})[str(f.type)]}" for f in _OUT)
    done = df.withColumn("__rules", F.arrow_udf(run, kinds, ArrowUDFType.SCALAR_ITER)(text_of(df, text_col)))
    return put(done, {f.name: done["__rules"][f.name] for f in _OUT}).drop("__rules")
