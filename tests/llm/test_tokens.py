import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from versionlog.llm import bpe, bpe_codec, token_counts, token_output

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "   \n\t ", "Hello world", "don't we'll I'M 'twas ''s", "a.b,c!! ... (x)", "3.14 2024 ½ ²", "naïve ÀÉÎ ßtraße Ÿ ſ",
    "İstanbul ΣΑΣ ς ﬁ é 日本語 \U0001f600\U0001f44d\U0001f3fc", "x\x1cy\x85z\xa0w v", "<|endoftext|>", "a<|startoftext|>b<|endoftext|", "A<|endoftext|> ́<|endoftext|>",
    "word" * 3000, "ab " * 4000, "!" * 777, "é" * 500, "zq" * 33 + "x", "\0\x01 \x7f",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tables():
    return bpe.tables_of(PATH)


def expected(library, texts):
    return [library.encode(x or "", add_special_tokens=False).ids for x in texts]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string, source string")


def test_whole_words_are_proven(library, tables):
    words = tables.words()
    assert len(words) > 30_000
    for w in random.Random(0).sample(sorted(words), 400):
        got = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(w))
        if [x for x, _ in got] == ["".join(bpe.byte_chars()[b] for b in w.encode())]:
            assert library.encode(w, add_special_tokens=False).ids == [words[w]]


def test_every_character_splits_as_the_library_does(library, tables):
    pre = bpe.PreTokens(tables)
    for c in [*range(0x600), *range(0x2000, 0x2100), *range(0x3000, 0x3040), 0x1E9E, 0xFB01, 0x1F600]:
        s = f"a{chr(c)}1B'S {chr(c)}{chr(c)}"
        want = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(s))]
        assert ["".join(bpe.byte_chars()[b] for b in w.encode()) for w in pre(s)] == want, hex(c)


def test_codec_and_counter_match_the_library(library, tables):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdefgh éß.,'!1 ") for _ in range(rng.randrange(200))) for _ in range(200)]
    want = expected(library, texts)
    codec, counter = bpe_codec.Codec(tables), token_counts.Counter(tables)
    assert [x.tolist() for x in codec.encode(texts)] == want
    assert [counter.count(x) for x in texts] == [len(x) for x in want]
    assert [codec.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_compatible_pairs_are_those_that_merging_keeps_apart(tables):
    codec, rng = bpe_codec.Codec(tables), np.random.default_rng(2)
    usable = np.array([i for i, s in enumerate(tables.spelled) if s and tables.alone[i]])
    inner = np.array([i for i in usable if not tables.tokens[i].endswith("</w>")])
    a, b = rng.choice(inner, 3000), rng.choice(usable, 3000)
    want = [bpe.merge(tables.spelled[x] + tables.spelled[y], tables.merges)[0] == [x, y] for x, y in zip(a, b)]
    assert codec.compatible(a, b).tolist() == want
    assert 0 < sum(want) < 3000


def test_memo_generations(tables, library, monkeypatch):
    codec = bpe_codec.Codec(tables)
    codec.words.most = 3
    for _ in range(2):
        assert [x.tolist() for x in codec.encode(TEXTS)] == expected(library, TEXTS)
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 300)
    counter = token_counts.Counter(tables)
    assert [counter.count(x) for x in TEXTS * 2] == [len(x) for x in expected(library, TEXTS * 2)]


def test_other_vocabularies_are_refused():
    import json

    with pytest.raises(ValueError):
        bpe.tables_of(public_tokenizers.path("byte_bpe_50k.json"))
    with open(PATH) as f:
        file = json.load(f)
    bpe.refuse_others(file)
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"model": {**file["model"], "ignore_merges": True}}, {"added_tokens": [{**file["added_tokens"][0], "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.refuse_others({**file, **change})


def test_many_empty_documents_make_several_segments(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_DOCS", 100)
    path = f"file://{tmp_path}/out"
    token_output.write_tokens(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), PATH, path, 2)
    assert token_output.read_segments(spark, path).count() >= 10
    assert [r.start for r in token_output.read_documents(spark, path).orderBy("doc_id").collect()] == list(range(1000))


def test_operators_on_odd_rows(spark, library):
    rows = [(k, t, "old", None) for k, t in enumerate(TEXTS)] + [(3, None, "old", "s"), (None, "two words", "old", "s"), (3, None, "old", "s")]
    df = table(spark, rows)
    counted = token_counts.count_tokens(df, PATH)
    assert [c.lower() for c in counted.columns].count("n_tokens") == 1 and "source" in counted.columns
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in counted.collect()]
    want = expected(library, [r[1] for r in rows])
    assert got == [(r[0], len((r[1] or "").encode()), len(w)) for r, w in zip(rows, want)]
    encoded = bpe_codec.encode(df, PATH)
    back = bpe_codec.decode(encoded, PATH)
    assert [(r.ids, r.decoded) for r in back.collect()] == [(w, library.decode(w, skip_special_tokens=False)) for w in want]
    trip = bpe_codec.round_trip(df, PATH).collect()
    assert [r.ids_sha256 for r in trip] == [hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest() for w in want]
    assert [r.decoded_sha256 for r in trip] == [hashlib.sha256(library.decode(w, skip_special_tokens=False).encode()).hexdigest() for w in want]
    for op in (token_counts.count_tokens, bpe_codec.encode, bpe_codec.round_trip):
        assert op(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("bits", [1, 8])
def test_segments_round_trip(bits):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 64, 1000):
        ids = rng.integers(0, 1 << int(rng.integers(1, 32)), n).astype(np.uint32)
        assert (token_output.unpack(token_output.pack(ids, bits, 64), n) == ids).all()
    with pytest.raises(ValueError):
        token_output.unpack(token_output.pack(ids, bits, 64), 10)


@pytest.mark.parametrize("bits", [1, 8])
def test_written_documents_read_back(spark, library, tmp_path, bits):
    rows = [(k * 7 % 19, t, None, None) for k, t in enumerate(TEXTS)] + [(None, "no id", None, None), (4, None, None, None), (4, "same id", None, None)]
    path = f"file://{tmp_path}/out"
    token_output.write_tokens(table(spark, rows), PATH, path, 2, bits=bits, block_ids=100, segment_ids=300)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_output.read_documents(spark, path).collect()}
    want, start = {}, 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], start] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_empty_table_writes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    token_output.write_tokens(table(spark, []), PATH, path, 2)
    assert token_output.read_documents(spark, path).count() == 0


def test_counts_over_a_table(spark, library):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    got = token_counts.count_tokens(df.repartition(3), PATH).agg(F.sum("n_tokens")).first()[0]
    assert got == sum(map(len, expected(library, [f"word {k}" for k in range(50)])))


def test_merging_looks_up_only_new_pairs(tables, monkeypatch):
    """What stands beside one another in the bytes is known beforehand; each merge makes two pairs at most."""
    codec, asked = bpe_codec.Codec(tables), []
    look = codec.pair
    monkeypatch.setattr(codec, "pair", lambda a, b: asked.append(len(a)) or look(a, b))
    words = [b"a", "é".encode(), b"thonrestanden", b"zzqxj", b"x" * 200, bytes(range(33, 90)), b"oftionnten"]
    exact = [bpe.merge(bpe.spell(w, tables), tables.merges) for w in words]
    got = codec.merge_all(words)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids for ids, _ in exact]
    assert sum(asked) <= sum(2 * len(done) for w, (_, done) in zip(words, exact) if len(w) <= bpe_codec.LONG_WORD)
    assert codec.merge_all([]) == [] and codec.merge_all([b"x" * 200]) == [got[4]]
