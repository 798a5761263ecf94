"""Token counts by whole-token shortcut.

Offline, `bpe.tables` proves which vocabulary strings encode alone as one
token.  A pre-token found among them counts one at once; only the rest is
merged, exactly, and remembered in a bounded memo.

Defined results: a null or empty text has 0 tokens; special strings inside a
text count as the library counts them; rows keep their number, repeated rows
are counted each; an empty table gives an empty table; other columns pass
through, and input columns named like the outputs give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from . import bpe
from ._io import put, text_of
from .bpe import Shared

#: Memory, in bytes, for the words a worker remembers besides the proven ones, and what one takes besides its text.
MEMO_BYTES, ENTRY_BYTES = 56 << 20, 140


class Counter:
    def __init__(self, t: bpe.Tables) -> None:
        self.t, self.pre = t, bpe.PreTokens(t)
        self.whole = dict.fromkeys(t.words(), 1)
        self.whole |= dict.fromkeys(t.special.values(), 1)
        self.known, self.size = dict(self.whole), 0

    def count(self, text: str) -> int:
        words = self.pre(text)
        counts = list(map(self.known.get, words))
        if None in counts:
            for k, n in enumerate(counts):
                if n is None:
                    word = words[k]
                    if (n := self.known.get(word)) is None:
                        n = self.known[word] = len(bpe.merge(bpe.spell(word.encode(), self.t), self.t.merges)[0])
                        self.size += ENTRY_BYTES + len(word)
                    counts[k] = n
            if self.size > MEMO_BYTES:
                self.known, self.size = dict(self.whole), 0
        return sum(counts)


def count_tokens(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Add ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text."""
    shared = Shared.of(df, tokenizer)

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = shared.held(Counter)
        for batch in batches:
            yield pa.array([counter.count(x.as_py()) for x in batch], pa.int64())

    n_tokens = F.arrow_udf(counts, "long", ArrowUDFType.SCALAR_ITER)
    text = text_of(df, text_col)
    return put(df, {"n_bytes": F.octet_length(text).cast("long"), "n_tokens": n_tokens(text)})
