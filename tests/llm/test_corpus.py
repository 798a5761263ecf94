import hashlib
import importlib
import os
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from versionlog.llm import exact_dedup, mixing, ngram_join, substring_dedup
from versionlog.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().lower().split()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- components


def test_components(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5)]
    u = Union()
    for a, b in links:
        u.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: u.find(x) for x in u.up if u.find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (None, 2, 0), (3, 3, 0), (4, 5, 1), (5, 4, 2), (4, 5, 1)], "u long, v long, node int")
    assert [tuple(r) for r in components(odd).collect()] == [(5, 4)]


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components_by_rounds_and_at_once(spark, monkeypatch, at_once):
    module = importlib.import_module("versionlog.llm.components")
    monkeypatch.setattr(module, "AT_ONCE", at_once)
    rng = np.random.default_rng(11)
    links = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (130, 2))] + [(k, k + 1) for k in range(1000, 1020)] + [(7, 7)]
    u = Union()
    for a, b in links:
        u.join(a, b)
    found = components(spark.createDataFrame(links, "u long, v long").repartition(5))
    assert {r.node: r.component for r in found.collect()} == {x: u.find(x) for x in u.up if u.find(x) != x}
    assert at_once == 0 or len(found.inputFiles()) == 1  # no round dealt them out


def test_a_join_of_few_rows_takes_few_tasks(spark):
    """However many partitions the session has: of small tables most would be empty, and each has a file and a task."""
    texts = [(k, " ".join(f"w{(k // 4) * 100 + i}" for i in range(60)) + " x" * (k % 4)) for k in range(40)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
        joined = ngram_join.Joined(docs, ngram_join.Config(n=4, percent=85))
        assert joined.signed.rdd.getNumPartitions() == 1 and len(joined.found.inputFiles()) == 1
        assert {r.doc_id: r.component_id for r in joined.decisions().collect()} == {k: k // 4 * 4 for k, _ in texts}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# --- exact copies

COPIES = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "same text "), (5, "É"), (6, "é"), (7, None), (8, ""), (None, "same TEXT"), (9, "x" * 100_000), (10, "X" * 100_000), (2, "other"), (3, "Other"), (3, "other")]


def decided(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[(t or "").translate(LOW)].append(k)
    return sorted(((k is not None, k or 0), max((x is not None, x or 0) for x in groups[(t or "").translate(LOW)]), len(groups[(t or "").translate(LOW)])) for k, t in rows), groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 1).cast("binary"), lambda t: F.lit(b"same")])
def test_exact_copies_even_if_digests_collide(spark, digest):
    df = spark.createDataFrame([(k, t, "x") for k, t in COPIES], "doc_id long, text string, digest string")
    found = exact_dedup.Deduplicated(df, digest=digest)
    rows = found.decisions().collect()
    got = sorted(((r.doc_id is not None, r.doc_id or 0), (r.keep_id is not None, r.keep_id or 0), r.group_size) for r in rows)
    want, groups = decided(COPIES)
    assert got == want
    assert sum(r.kept for r in rows) == len(groups)
    stay = found.unique()
    assert stay.columns == df.columns and stay.count() == len(groups)
    assert {(r.text or "").translate(LOW) for r in stay.collect()} == set(groups)


def test_exact_dedup_of_files_and_empty(spark, tmp_path):
    df = spark.createDataFrame(COPIES, "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "d"))
    found = exact_dedup.Deduplicated(spark.read.parquet(str(tmp_path / "d")))
    assert found.regrouped is None
    digests = {r.text: hashlib.sha256((r.text or "").translate(LOW).encode()).digest() for r in df.collect()}
    assert {bytes(r.digest) for r in found.decisions().collect()} == set(digests.values())
    nothing = exact_dedup.Deduplicated(df.limit(0))
    assert nothing.decisions().count() == 0 and nothing.unique().count() == 0


def test_state_goes_on(spark, tmp_path):
    """A second call takes new files only and keeps what it knew."""
    queue, state = str(tmp_path / "q"), str(tmp_path / "s")
    rows = spark.createDataFrame([(1, b"d", "f", 0), (5, b"e", "f", 1)], "doc_id long, digest binary, path string, row long")
    rows.write.parquet(queue)
    exact_dedup.ingest(spark, queue, state)
    spark.createDataFrame([(9, b"d", "g", 0)], rows.schema).write.mode("append").parquet(queue)
    exact_dedup.ingest(spark, queue, state)
    got = {bytes(r.digest): (r.keep.doc_id, r.keep.path, r.n) for r in exact_dedup.read_state(spark, state).collect()}
    assert got == {b"d": (9, "g", 2), b"e": (5, "f", 1)}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.lit(b"same")])
def test_a_second_call_goes_on_with_further_documents(spark, tmp_path, digest):
    one, two = COPIES[:7], COPIES[7:]
    files = []
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"d{k}"))
        files.append(spark.read.parquet(str(tmp_path / f"d{k}")))
    first = exact_dedup.Deduplicated(files[0], digest=digest)
    assert first.decisions().count() == len(one)
    second = exact_dedup.Deduplicated(files[1], digest=digest, queue=first.queue_path, state=first.state_path)
    rows = second.decisions().collect()
    want, groups = decided(COPIES)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), (r.keep_id is not None, r.keep_id or 0), r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    # of the further documents those stay that no earlier one replaces
    stay = {(r.doc_id, r.text) for r in second.unique().collect()}
    assert stay <= set(two) and all(any((t or "").translate(LOW) == (x or "").translate(LOW) for x in dict.fromkeys(t for _, t in COPIES)) for _, t in stay)
    assert {(t or "").translate(LOW) for _, t in stay} >= {(t or "").translate(LOW) for _, t in two} - {(t or "").translate(LOW) for _, t in one}


# --- similar documents


def grams(text, n):
    w = words(text)
    return frozenset(b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([b" ".join(w)] if w else [])


def linked(rows, n, percent):
    u, sets = Union(), [(k, grams(t, n)) for k, t in rows if k is not None]
    for i, (a, x) in enumerate(sets):
        u.find(a)
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u.join(a, b)
    return u


def family_rows(seed, n=150):
    rng = np.random.default_rng(seed)
    stock = [f"w{k}" for k in range(300)]
    phrase = " ".join(rng.choice(stock, 30))
    rows, base = [], []
    for k in range(n):
        if k % 15 == 0:
            base = list(rng.choice(stock, rng.integers(1, 120)))
        edited = [str(rng.choice(stock)) if rng.random() < 0.02 * (k % 5) else str(w) for w in base]
        rows.append((k, " ".join(edited) + (f"\n{phrase}" if k % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("n, percent, block, pivots", [(4, 85, 1024, 8), (5, 80, 1024, 2), (4, 85, 5, 2), (2, 50, 7, 3), (1, 90, 3, 2)])
def test_join_matches_all_pairs(spark, monkeypatch, n, percent, block, pivots):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    rows = family_rows(n + block) + [(500, None), (501, ""), (502, "One two"), (503, "one  TWO"), (504, "one"), (505, "A b c d e f"), (506, "a b c d e f g"), (507, "a b c d e f g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.Joined(df, ngram_join.Config(n, percent)).decisions().collect()}
    u = linked(rows, n, percent)
    assert got == {k: (len(grams(t, n)), u.find(k)) for k, t in rows}
    assert len({c for _, c in got.values()}) < len(rows)


def test_join_on_odd_rows(spark):
    rows = [(1, "a b c d e f", 0), (1, "q r s t u v", 0), (2, "q r s t u v", 0), (3, "a b c d e f", 0), (None, "a b c d e f", 0), (9, "z " * 50_000, 0), (10, "Z " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    joined = ngram_join.Joined(df)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in joined.decisions().collect()) == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 1), (9, 9), (10, 9)]
    stay = joined.keep_one()
    assert stay.columns == df.columns and sorted(r.doc_id or -1 for r in stay.collect()) == [-1, 1, 1, 9]
    assert ngram_join.Joined(df.limit(0)).decisions().count() == 0


def test_a_very_long_text_joins(spark):
    """A million words; its bitmap is folded in tiles and compared whole for its pairs."""
    rng = np.random.default_rng(14)
    long = [f"w{k}" for k in rng.integers(0, 1 << 40, 1_000_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:990_000])), (3, " ".join(long[:700_000])), (4, " ".join(long[10:60]))]
    got = {r.doc_id: r.component_id for r in ngram_join.Joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).decisions().collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_large_family_without_links(spark, monkeypatch):
    """Members share half of their n-grams and link with none; a few have a near copy."""
    monkeypatch.setattr(ngram_join, "BLOCK", 400)
    rng = np.random.default_rng(15)
    common = " ".join(other_words(rng, 24))
    rows = [(k, common + " " + " ".join(other_words(rng, 20))) for k in range(1500)]
    rows += [(5000 + k, rows[k][1] + " more") for k in range(0, 1500, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.Joined(df, ngram_join.Config(4, 85)).decisions().collect()}
    assert got == {k: (k - 5000 if k >= 5000 else k) for k, _ in rows}


def test_a_pair_that_meets_in_several_tiles_is_named_once():
    rng, m = np.random.default_rng(19), 12
    common = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    held = [np.sort(np.concatenate([common, rng.integers(0, 1 << 62, 4).astype(np.uint64)])) for _ in range(m)]
    keys = [np.array(x) for x in [[3, 5, 9]] * 6 + [[5, 9]] * 6]
    named = []
    for key in (3, 5, 9):
        at = [k for k in range(m) if key in keys[k]]
        group = {c: np.zeros(len(at), np.int64) for c in ("i", "j", "block")}
        group |= {"id": np.array(at), "component": np.array(at), "n": np.full(len(at), 104), "lower": np.zeros(len(at), bool), "key": np.full(len(at), key)}
        u, v, more = ngram_join._across(group | {"bits": [ngram_join.bitmap(held[k], 2) for k in at], "keys": [keys[k] for k in at]}, 80, m)
        assert not more
        named += zip(u.tolist(), v.tolist())
    assert sorted(named) == [(u, v) for u in range(m) for v in range(u)]


def test_first_tiles_are_enough_to_name_every_pair():
    """Members know some of their tiles: each pair with a tile in common is named, and once if both know one in common."""
    rng, m, most = np.random.default_rng(20), 16, 6
    common = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    bits = [ngram_join.bitmap(np.sort(np.concatenate([common, rng.integers(0, 1 << 62, 4).astype(np.uint64)])), 2) for _ in range(m)]
    keys = [np.sort(rng.choice(40, rng.integers(4, 30), replace=False)) for _ in range(m)]
    named = Counter()
    for key in range(40):
        at = [k for k in range(m) if key in keys[k]]
        if len(at) > 1:
            group = {c: np.zeros(len(at), np.int64) for c in ("i", "j", "block")}
            group |= {"id": np.array(at), "component": np.array(at), "n": np.full(len(at), 104), "lower": np.zeros(len(at), bool), "key": np.full(len(at), key)}
            u, v, _ = ngram_join._across(group | {"bits": [bits[k] for k in at], "keys": [keys[k][:most] for k in at]}, 80, m)
            named.update(zip(u.tolist(), v.tolist()))
    for u in range(m):
        for v in range(u):
            both = set(keys[u].tolist()) & set(keys[v].tolist())
            assert (named[u, v] > 0) == bool(both)
            if set(keys[u][:most].tolist()) & set(keys[v][:most].tolist()):
                assert named[u, v] == 1


def test_a_join_leaves_little_behind(spark):
    """Its tiles, members and sets go once its components are stored; results can still be read."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(os.listdir(folder))
    rows = family_rows(60)
    joined = ngram_join.Joined(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Config(4, 85))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"join-signatures", "join-equal", "join-copies", "join-tested", "links"}
    u = linked(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in joined.decisions().collect()} == {k: u.find(k) for k, _ in rows}


def test_texts_that_are_hashed_together(monkeypatch):
    rng = np.random.default_rng(33)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 90, k % 7 * (k % 3))) + "\n" * (k % 2) for k in range(60)] + ["", " ", "é a\tB", "x" * 300, "a b " * 90]
    for n, size in ((1, 50), (3, 200), (5, 1 << 17)):
        monkeypatch.setattr(ngram_join, "TOGETHER", size)
        shingle, found = ngram_join.Shingler(n), []
        for grams, bounds in shingle.together(texts):
            found += [grams[a:b].tolist() for a, b in bounds]
        assert found == [shingle.sequence(t).tolist() for t in texts]


def test_the_best_pairs_of_each_member(monkeypatch):
    rng = np.random.default_rng(16)
    one, other = np.triu_indices(12, 1)
    near = rng.permutation(len(one)) / 100
    kept = ngram_join._best(one, other, near, 2)
    want = {k for m in range(12) for k in sorted((k for k in range(len(one)) if m in (one[k], other[k])), key=lambda k: -near[k])[:2]}
    assert set(kept.tolist()) == want


def test_hashed_words_and_parts(monkeypatch):
    text = "Ab\tcd  é\x85f\n" * 300 + "x" * 500 + " end"
    whole = ngram_join.Shingler(3).sequence(text)
    assert len(set(ngram_join.Shingler(1).words("a b A c ab ba bA").tolist())) == 5
    monkeypatch.setattr(ngram_join, "PART_BYTES", 64)
    ngram_join._powers.cache_clear()
    assert (ngram_join.Shingler(3).sequence(text) == whole).all()
    ngram_join._powers.cache_clear()


def test_bitmap_bounds_never_fall_short():
    rng = np.random.default_rng(8)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, rng.integers(1, 300))), np.unique(rng.choice(pool, rng.integers(1, 300)))
        x, y = ngram_join.bitmap(a, 2, 256), ngram_join.bitmap(b, 2, 1024)
        w = min(len(x), len(y)) // 8
        bound = ngram_join.overlap_bound(ngram_join.folded(x, w), len(a), ngram_join.folded(y, w)[None], np.array([len(b)]))[0]
        assert bound >= len(np.intersect1d(a, b))


# --- passages


def test_compact_windows_hold_every_subsequence_once():
    rng, window = np.random.default_rng(9), 5
    for gaps in ([], [20, 23, 59], [0, 30]):
        hashed = rng.integers(1, 1 << 30, 60).astype(np.uint64) << np.uint64(26) | np.arange(60, dtype=np.uint64)
        hashed[gaps] = 0
        spans = list(zip(*(x.tolist() for x in substring_dedup.compact_windows(hashed, window))))
        for i in range(60):
            for j in range(i + window - 1, 60):
                holding = [c for a, c, b in spans if a <= i <= c <= j <= b]
                assert holding == ([] if any(i <= g <= j for g in gaps) else [i + int(np.argmin(hashed[i : j + 1]))])
        assert all(b - a + 1 >= window for a, _, b in spans)


@pytest.mark.parametrize("vocabulary", [3, 50, 1 << 60])
def test_intervals_part_all_window_starts(vocabulary):
    rng, config = np.random.default_rng(vocabulary % 97), substring_dedup.Config(window=7, hashes=4)
    tokens = rng.integers(1, vocabulary + 1, 90).astype(np.uint64)
    for x in substring_dedup.intervals(tokens, np.zeros(90, bool), config):
        assert x.start[0] == 0 and x.end[-1] == 90 - 7 and (x.start[1:] == x.end[:-1] + 1).all()
        for a, b, token in zip(x.start, x.end, x.token):
            assert all(token in tokens[k : k + 7] for k in (a, b))
    together = [substring_dedup.keys(tokens, np.zeros(90, bool), config)[k] for k in (0, 1)]
    assert all(len(k.start) == len(np.unique(k.start)) for k in together)


def near_windows(one, other, config):
    """near[i, j]: so many tokens of the window at i are in that at j, and the other way, by looking at all."""
    w = config.window

    def counts(a, b):
        same = np.zeros((len(a), len(b) + 1), np.int32)
        same[:, 1:] = np.cumsum(a[:, None] == b[None], axis=1)
        inside = np.zeros((len(a) + 1, len(b) - w + 1), np.int32)
        inside[1:] = np.cumsum(same[:, w:] > same[:, :-w], axis=0)
        return inside[w:] - inside[:-w]

    if min(len(one), len(other)) < w:
        return np.zeros((0, 0), bool)
    return (counts(one, other) >= config.shared) & (counts(other, one).T >= config.shared)


def other_words(rng, n=60):
    return [f"w{k}" for k in rng.integers(0, 1 << 40, n)]


#: words of a passage, words from one change in it to the next
NEAR = [(50, 60), (50, 45), (50, 40), (54, 60), (60, 60), (60, 45), (60, 40), (100, 50), (100, 40), (200, 45), (200, 40)]


@pytest.mark.parametrize("size, spacing", NEAR)
def test_recall_of_near_passages(size, spacing):
    """Of pairs with near windows among all, at least nine of ten share a key, a longer key and a verified window."""
    rng, config, shingle = np.random.default_rng(size + spacing), substring_dedup.Config(), ngram_join.Shingler(5)
    total = short = long = found = same = windows = 0
    for k in range(150):
        p = [f"p{x}" for x in rng.integers(0, 1 << 40, size)]
        q = list(p)
        for at in range(int(rng.integers(0, spacing)), size, spacing):
            q[at : at + (1, 1, 2)[k % 3]] = (["new"], ["new", p[at]], ["new"])[k % 3]
        one, other = (shingle.sequence(" ".join(other_words(rng) + x + other_words(rng))) for x in (p, q))
        near = near_windows(one, other, config)
        if not near.any():
            continue
        total += 1
        keys = [substring_dedup.keys(x, np.zeros(len(x), bool), config) for x in (one, other)]
        all_keys = [np.sort(np.concatenate([b.token for b in x])) for x in keys]
        short += np.isin(*all_keys).any()
        longer = [np.concatenate([b.token for b in substring_dedup.longer_keys(x, a)]) for x, a in zip(keys, all_keys)]
        long += np.isin(*longer).any()
        a, b = substring_dedup.passages(*substring_dedup.windows_of([one, other], config), config)
        found += len(a) > 0
        assert near.any(1)[a].all() and near.any(0)[b].all()
        same += len(a)
        windows += near.any(1).sum()
    assert total > 60
    assert min(short, long, found) >= 0.95 * total and same >= 0.9 * windows, (short, long, found, total, same, windows)


def test_every_near_window_is_found_and_shares_a_key():
    """Against all pairs of windows, with few and with many different tokens, changes, insertions and blocks that moved."""
    rng, total = np.random.default_rng(18), 0
    for t in range(150):
        config = substring_dedup.Config(n=1, window=[7, 12, 20, 46][t % 4], percent=[50, 60, 80][t % 3])
        words_ = substring_dedup._mix(np.arange(1, [3, 8, 40, 1000][t // 4 % 4] + 1, dtype=np.uint64))
        a = rng.integers(0, len(words_), rng.integers(config.window, 90))
        b = a.copy()
        for _ in range(rng.integers(0, 8)):
            k = rng.integers(0, len(b))
            new = rng.integers(0, len(words_), rng.integers(1, 4))
            b = [np.concatenate([b[:k], new, b[k + 1 :]]), np.insert(b, k, new), np.concatenate([b[k:], b[:k]])][rng.integers(0, 3)]
        one, other = words_[a], words_[b]
        near = near_windows(one, other, config)
        x, y = substring_dedup.passages(*substring_dedup.windows_of([one, other], config), config)
        assert (x.tolist(), y.tolist()) == (np.flatnonzero(near.any(1)).tolist(), np.flatnonzero(near.any(0)).tolist())
        held = []
        for tokens in (one, other):
            valid = np.arange(len(tokens)) <= len(tokens) - config.window
            nodes, first, last = substring_dedup.least_tokens(tokens, np.full(len(tokens), 2), valid, config)
            held.append([{int(k) for k in tokens[nodes[(first <= w) & (w <= last)]]} for w in range(valid.sum())])
        assert all(held[0][i] & held[1][j] for i, j in zip(*np.nonzero(near)))
        total += near.any()
    assert total > 100


def test_pairs_that_tell_no_new_words_are_told_apart():
    """Of texts whose spans are partly known: a near window with a new word on either side is never left out."""
    rng, left = np.random.default_rng(21), 0
    for t in range(200):
        config = substring_dedup.Config(n=1, window=[7, 12, 20][t % 3], percent=[60, 80][t % 2])
        words_ = substring_dedup._mix(np.arange(1, [4, 30, 1000][t // 3 % 3] + 1, dtype=np.uint64))
        a = rng.integers(0, len(words_), 70)
        texts = [words_[a], words_[np.concatenate([rng.integers(0, len(words_), 20), a[: rng.integers(0, 60)], rng.integers(0, len(words_), 20)])]]
        one, other = substring_dedup.windows_of(texts, config)
        found = substring_dedup.passages(one, other, config)
        known = []
        for x, starts, which in zip(texts, found, rng.integers(0, 3, 2)):
            s = substring_dedup.spans(starts, config) if len(starts) else []
            known.append([s, [{"first": 0, "end": int(rng.integers(0, len(x)))}], None][which])
        new = [substring_dedup.outside(np.arange(len(x)), s, config) for x, s in zip(texts, known)]
        fresh = any(n[starts].any() for n, starts in zip(new, found))
        may = substring_dedup.may_tell(one, other, one.standing(new[0]), other.standing(new[1]), config)
        assert may or not fresh
        assert substring_dedup.linked(one, other, config) == (len(found[0]) > 0)
        left += len(found[0]) > 0 and not may
    assert left > 10


def test_pairs_are_tested_together_without_a_sweep(monkeypatch):
    """Texts without repeated tokens, and those of few different windows: all near windows, nothing swept or held against each other one by one."""

    def never(*_, **__):
        raise AssertionError("pair by pair")

    for name in ("_sweep", "_each", "_both"):
        monkeypatch.setattr(substring_dedup, name, never)
    monkeypatch.setattr(substring_dedup, "PART", 1000)
    rng, linked_, told = np.random.default_rng(31), [0, 0, 0], 0
    for t in range(60):
        config = substring_dedup.Config(n=1, window=[7, 12, 20, 46][t % 4], percent=[50, 60, 80][t % 3])
        texts = []
        for _ in range(3):
            a = rng.permutation(4000)[: rng.integers(60, 200)]
            if t % 5 > 2:  # words said over and over
                a = np.resize(a[: rng.integers(3, 30)], len(a))
            texts.append(a)
            for _ in range(int(rng.integers(0, 4))):  # blocks that moved, words left out and new ones
                b = a.copy()
                for _ in range(int(rng.integers(0, 6))):
                    k, m = np.sort(rng.integers(0, len(b), 2))
                    b = [np.concatenate([b[:k], b[m:], b[k:m]]), np.delete(b, k), np.insert(b, k, 5000 + rng.integers(0, 1 << 40))][rng.integers(0, 3)]
                if len(b) >= config.window:
                    texts.append(b)
        texts = [substring_dedup._mix(x.astype(np.uint64) + np.uint64(1)) for x in texts]
        held = substring_dedup.windows_of(texts, config)
        pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
        tests = []
        for k, (i, j) in enumerate(pairs):
            new = [held[x].standing(rng.random(len(texts[x])) < 0.01) for x in (i, j)] if k % 2 else [None, None]
            tests.append((held[i], held[j], *new))
        for (i, j), test, found in zip(pairs, tests, substring_dedup.tested(tests, config)):
            near = near_windows(texts[i], texts[j], config)
            assert (found is not None) == near.any()
            if found is None:
                continue
            linked_[held[i].distinct + held[j].distinct] += 1
            if test[2] is not None and not substring_dedup.may_tell(*test, config):
                assert not len(found[0]) and not len(found[1])
                told += 1
            else:
                assert [x.tolist() for x in found] == [np.flatnonzero(near.any(1)).tolist(), np.flatnonzero(near.any(0)).tolist()]
    assert linked_[0] > 50 and linked_[2] > 50 and told > 10, (linked_, told)


def test_windows_of_distinct_tokens_need_no_second_count():
    """Large texts of which few tokens repeat, far apart or in one window: swept, with the same near windows."""
    rng, config = np.random.default_rng(32), substring_dedup.Config(n=1, window=12, percent=60)
    for t in range(40):
        a = rng.permutation(4000)[:150]
        a[100 : 100 + t] = a[: t]
        a[60 : 60 + t % 3] = a[62]
        b = np.concatenate([a[70:], a[:50], rng.integers(5000, 1 << 40, 9), a[50:70]])
        one, other = (substring_dedup._mix(x.astype(np.uint64) + np.uint64(1)) for x in (a, b))
        near, held = near_windows(one, other, config), substring_dedup.windows_of([one, other], config)
        assert held[0].repeating[: 150 - 11].tolist() == [len(set(a[k : k + 12].tolist())) < 12 for k in range(150 - 11)]
        for x, y, n in ((*held, near), (*held[::-1], near.T)):
            assert [s.tolist() for s in substring_dedup._searched(x, y, config)] == [np.flatnonzero(n.any(1)).tolist(), np.flatnonzero(n.any(0)).tolist()]


def passage_rows():
    rng = np.random.default_rng(10)
    stock = [f"t{k}" for k in range(5000)]
    text = lambda n: [str(w) for w in rng.choice(stock, n)]
    shared, near = text(60), text(90)
    rows = [(k, " ".join(text(int(rng.integers(1, 200))))) for k in range(40)]
    rows += [(100 + k, " ".join(text(50) + [w.upper() for w in shared] + text(20 * k))) for k in range(6)]
    rows += [(200, " ".join(text(30) + near)), (201, " ".join(near[:45] + ["changed"] + near[46:] + text(10)))]
    rows += [(300, " ".join(shared[:49])), (301, None), (302, "")]
    return rows


def test_planted_passages_are_found(spark):
    rows = passage_rows()
    found = substring_dedup.Passages(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int"))
    got = {r.doc_id: r for r in found.decisions().collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if r.n_links} >= {100, 101, 102, 103, 104, 105, 200, 201}
    assert not [k for k, r in got.items() if k < 100 and r.n_links]
    assert {got[k].class_id for k in range(100, 106)} == {100} and got[201].class_id == 200
    assert got[100].kept and not got[103].kept and got[103].partners and set(got[103].partners) <= {100, 101, 102}
    first, end = map(int, got[103].passages.split(":"))
    assert first <= 50 and end >= 110 and end - first <= 62 + 10


def test_exact_passages_are_never_missed(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_TOKENS", 500)
    rows = family_rows(11, 60)
    seen = defaultdict(set)
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - 49):
            seen[b" ".join(w[i : i + 50])].add(k)
    repeated = {k for ks in seen.values() if len(ks) > 1 for k in ks}
    found = substring_dedup.Passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert repeated <= {r.doc_id for r in found.decisions().where("n_links > 0").collect()} and repeated


def test_passages_on_odd_rows(spark):
    same = " ".join(f"p{k}" for k in range(80))
    rows = [(1, same), (1, same), (None, same), (2, same), (3, None)]
    found = substring_dedup.Passages(spark.createDataFrame(rows, "doc_id long, text string")).decisions()
    assert found.count() == 5 and {r.doc_id for r in found.where("n_links > 0").collect()} == {1, 2}
    assert substring_dedup.Passages(spark.createDataFrame([], "doc_id long, text string")).decisions().count() == 0


def held_against_all(rows):
    """Of all pairs with near windows: classes, later texts, number of pairs, and starts of near windows of each side."""
    config, shingle, union = substring_dedup.Config(), ngram_join.Shingler(5), Union()
    seqs, later, near = {k: shingle.sequence(t or "") for k, t in rows}, set(), {}
    for a in seqs:
        for b in seqs:
            if a < b and (found := near_windows(seqs[a], seqs[b], config)).any():
                union.join(a, b)
                later.add(b)
                near[a, b] = (np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0)))
    return {k: min(j for j in seqs if union.find(j) == union.find(k)) for k in seqs}, later, near


def check_passages(spark, rows):
    classes, later, near = held_against_all(rows)
    found = substring_dedup.Passages(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int").repartition(3))
    got = found.decisions().collect()
    assert {r.doc_id: r.class_id for r in got} == classes
    assert {r.doc_id for r in got if not r.kept} == later
    links = found.links.collect()
    pairs = [(r.u, r.v) for r in links]
    assert len(set(pairs)) == len(pairs) and set(pairs) <= set(near)
    config = substring_dedup.Config()
    for r in links:
        for spans, starts in zip((r.u_spans, r.v_spans), near[r.u, r.v]):
            whole = substring_dedup.spans(starts, config)
            # each is part of one that holds all near windows, and the ends differ by a few words
            assert all(any(w["first"] <= s.first and s.end <= w["end"] for w in whole) for s in spans)
            assert sum(w["end"] - w["first"] for w in whole) - sum(s.end - s.first for s in spans) <= 8 * len(whole)
    count = defaultdict(int)
    for u, v in pairs:
        count[u] += 1
        count[v] += 1
    assert all(r.n_links == count[r.doc_id] and set(r.partners) == {u for u, v in pairs if v == r.doc_id} for r in got)
    for r in got:
        of = [(s.first, s.end) for x in links if r.doc_id in (x.u, x.v) for s in (x.u_spans if x.u == r.doc_id else x.v_spans)]
        covered = {k for a, b in of for k in range(a, b)}
        shown = [tuple(map(int, x.split(":"))) for x in r.passages.split(",") if x]
        assert {k for a, b in shown for k in range(a, b)} == covered and r.n_repeated_words == len(covered)
    return len(pairs), len(near)


def test_passages_match_all_pairs(spark):
    check_passages(spark, passage_rows() + [(1000 + k, t) for k, t in family_rows(13, 60)[:40]])


def variants(rng, families, copies):
    """Of each passage of 50 words, first a variant too far from it, then exact copies, among other text."""
    rows = []
    for f in range(families):
        p = [f"p{k}" for k in rng.integers(0, 1 << 40, 50)]
        far = [*p]
        far[2] = far[46] = "changed"
        for k, q in enumerate([far] + [p] * copies):
            rows.append((1000 * k + f, " ".join(other_words(rng) + q + other_words(rng))))
    return rows


@pytest.mark.parametrize("few, pivots", [(4, 2), (2, 1)])
def test_texts_that_fail_against_the_first_are_held_against_each_other(spark, monkeypatch, few, pivots):
    monkeypatch.setattr(substring_dedup, "FEW", few)
    monkeypatch.setattr(substring_dedup, "PIVOTS", pivots)
    linked, n = check_passages(spark, variants(np.random.default_rng(3), 25, 2))
    assert linked == n == 25


def test_large_families_behind_a_text_that_fails(spark, monkeypatch):
    """A short common line in all texts, and three families of copies of passages beside it."""
    monkeypatch.setattr(substring_dedup, "BESIDE", 7)
    rng = np.random.default_rng(4)
    line = other_words(rng, 25)
    passage = [other_words(rng, 70) for _ in range(3)]
    rows = [(k, " ".join(other_words(rng, 40) + line + other_words(rng, 40))) for k in range(30)]
    rows += [(100 + k, " ".join(other_words(rng, 20) + line + passage[k % 3] + other_words(rng, 20))) for k in range(45)]
    linked, n = check_passages(spark, rows)
    assert linked < n == 3 * 15 * 14 // 2


def test_words_said_over_and_over_tell_nothing_in_most_pairs(spark):
    """Runs of one word in all texts, between words of their own: each text meets a few others, not all."""
    rng = np.random.default_rng(31)
    run = lambda word: [word] * int(rng.integers(45, 120))
    rows = [(k, " ".join(other_words(rng, 20) + run("in") + other_words(rng, 20) + run("of") + run(f"own{k}") + run("in"))) for k in range(24)]
    linked, n = check_passages(spark, rows)
    assert n == 24 * 23 // 2 and linked <= 3 * 24


def test_pairs_of_rows_that_meet_often_wait_once():
    """Many rows of few documents with one key, of which all fit: the pairs of documents are kept, not those of rows."""
    size, docs = 2400, 8
    table = {"doc": np.repeat(np.arange(docs), size // docs), "n": np.full(size, 60), "settled": np.zeros(size, bool), "later": np.zeros(size, bool), "class": np.arange(size)}
    tracemalloc.start()
    found = substring_dedup.further_pairs(table, np.ones((size, 8), np.uint64), np.array([size]), 41, 10_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20, peak
    assert sorted(map(tuple, found[0].T.tolist())) == [(a, b) for a in range(docs) for b in range(a + 1, docs)] and found[-1] == []


def test_equal_texts_follow_the_first(spark):
    rng = np.random.default_rng(6)
    text = " ".join(other_words(rng, 80))
    rows = [(k, text if k % 2 else text.upper()) for k in range(5, 25)] + [(30, " ".join(other_words(rng, 9)) + " " + text), (31, "short"), (32, "Short")]
    got = {r.doc_id: r for r in substring_dedup.Passages(spark.createDataFrame(rows, "doc_id long, text string")).decisions().collect()}
    assert all(got[k].class_id == 5 and got[k].passages == "0:80" for k in range(5, 25)) and got[30].class_id == 5 and got[5].n_links == 20
    assert got[5].kept and not any(got[k].kept for k in [*range(6, 25), 30]) and got[32].kept and got[31].n_links == 0


def test_long_and_repetitive_texts(spark):
    rng = np.random.default_rng(7)
    long = other_words(rng, 20_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[:9000] + other_words(rng, 30) + long[9000:])), (3, "z " * 20_000), (4, "z " * 15_000), (5, "y z " * 900)]
    got = {r.doc_id: r for r in substring_dedup.Passages(spark.createDataFrame(rows, "doc_id long, text string")).decisions().collect()}
    assert got[2].class_id == 1 and got[2].n_repeated_words >= 19_900 and got[4].class_id == 3 and got[5].n_links == 0


# --- mixing


def share(amount, children):
    """children: (name, weight, supply) -> given.  By the definition, in fractions: as long as a share is no less
    than a supply that child is full; then whole tokens, and those left over to the largest fractions."""
    given, rest = {n: 0 for n, _, _ in children}, amount
    open_ = [c for c in children if c[1] > 0]
    while open_:
        total = sum(Fraction(w) for _, w, _ in open_)
        full = [c for c in open_ if Fraction(rest) * Fraction(c[1]) / total >= c[2]]
        if not full:
            shares = {n: Fraction(rest) * Fraction(w) / total for n, w, _ in open_}
            given |= {n: int(x) for n, x in shares.items()}
            over = rest - sum(map(int, shares.values()))
            for n in sorted(shares, key=lambda n: (-round(float(shares[n] - int(shares[n])), 6), n))[:over]:
                given[n] += 1
            break
        for n, _, supply in full:
            given[n] = supply
            rest -= supply
        open_ = [c for c in open_ if c not in full]
    return given


def mixed(rows, weights, budget, epochs, seed=42):
    """Rows (doc_id, domain, language, source, text) taken, as (doc_id, epoch)."""
    tokens = defaultdict(int)
    for _, d, l, s, t in rows:
        tokens[d, l, s] += len(words(t))
    w = lambda level, name: weights.get(level, {}).get(name, 1)

    def supply(*p):
        """What a node can pass on: its own tokens, or the supplies of its children whose weight is above 0."""
        if len(p) == 3:
            return epochs * tokens[p]
        level = ("language", "source")[len(p) - 1]
        return sum(supply(*p, c) for c in {k[len(p)] for k in tokens if k[: len(p)] == p} if w(level, c) > 0)

    out = []
    domains = share(budget, [(d, w("domain", d), supply(d)) for d in {k[0] for k in tokens}])
    for d, a in domains.items():
        langs = share(a, [(x, w("language", x), supply(d, x)) for x in {k[1] for k in tokens if k[0] == d}])
        for x, b in langs.items():
            for s, c in share(b, [(s, w("source", s), supply(d, x, s)) for s in {k[2] for k in tokens if k[:2] == (d, x)}]).items():
                have = tokens[d, x, s]
                full = c // have if have else 0
                docs = [(k, len(words(t))) for k, dd, ll, ss, t in rows if (dd, ll, ss) == (d, x, s)]
                out += [(k, e) for k, _ in docs for e in range(full)]
                left = c - full * have
                for k, n in sorted(docs, key=lambda q: (hashlib.md5(f"{seed}:{full}:{q[0]}".encode()).hexdigest(), q[1])) if left > 0 else []:
                    left -= n
                    if left < 0:
                        break
                    out.append((k, full))
    return sorted(out)


WEIGHTS = {"domain": {"web": 5, "books": 2}, "language": {"en": 3, "xx": 0}, "source": {"s1": 4}}
ZEROS = {"domain": {"web": 0.7, "code": 0}, "language": {"de": 0, "xx": 0.1}, "source": {"s0": 0, "s1": 3}}


@pytest.mark.parametrize("weights", [WEIGHTS, ZEROS])
@pytest.mark.parametrize("budget, epochs", [(500, 1), (3001, 2), (9000, 3), (10**6, 2), (0, 2)])
def test_mix_matches_a_plain_one(spark, budget, epochs, weights):
    rng = np.random.default_rng(12)
    rows = [(k, str(rng.choice(["web", "books", "code"])), str(rng.choice(["en", "de", "xx"])), f"s{rng.integers(0, 3) if k % 3 else 1}", "w " * int(rng.integers(0, 30))) for k in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, domain string, lang string, source string, text string, epoch string")
    mix = mixing.Mix(F.col("domain"), F.col("lang"), F.col("source"), weights, budget_tokens=budget, max_epochs=epochs)
    out = mixing.Mixed(df, mix)
    assert sorted((r.doc_id, r.epoch) for r in out.decisions().collect()) == mixed(rows, weights, budget, epochs)
    sample = out.sample()
    assert sample.columns == df.columns and sample.count() == out.decisions().count()


def test_no_budget_is_lost_below_a_weight_of_zero(spark):
    rows = [(k, d, l, "s", "w") for d, l, n in (("a", "xx", 1000), ("a", "en", 100), ("b", "en", 2000)) for k in range(n)]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, domain string, lang string, source string, text string")
    mix = mixing.Mix(F.col("domain"), F.col("lang"), F.col("source"), {"language": {"xx": 0}}, budget_tokens=1000, max_epochs=1)
    out = mixing.Mixed(df, mix)
    assert {(r.domain, r.language): r.budget for r in out.plan.collect()} == {("a", "xx"): 0, ("a", "en"): 100, ("b", "en"): 900}
    assert out.decisions().count() == 1000


def test_fractions_of_tokens_are_carried(spark):
    rows = [(k, f"d{k % 7}", "en", "s", "w") for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, text string")
    out = mixing.Mixed(df, mixing.Mix(F.col("domain"), F.col("lang"), F.col("source"), budget_tokens=100, max_epochs=1))
    assert sorted(r.budget for r in out.plan.collect()) == [14] * 5 + [15] * 2
    assert out.decisions().count() == 100


def test_mix_on_odd_rows(spark):
    rows = [(1, "a b", None, None), (1, "a b", None, None), (None, "c d", "en", "s"), (3, None, "en", "s"), (4, "x " * 50_000, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(F.lit("all"), F.col("lang"), F.col("source"), budget_share=1.0, max_epochs=1)
    taken = [r.doc_id for r in mixing.Mixed(df, mix).decisions().collect()]
    # two leaves of weight 1 share 50,006 tokens: the small one is full (4 tokens), the other too
    assert sorted(x or -1 for x in taken) == [-1, 1, 1, 3, 4]
    half = mixing.Mix(F.lit("all"), F.col("lang"), F.col("source"), budget_tokens=3, max_epochs=1)
    # 2 tokens for the leaf of nulls, whose rows tie and so go together or not at all; 1 for the other, whose first row is the long one or that of "c d"
    taken = sorted(r.doc_id or -1 for r in mixing.Mixed(df, half).decisions().collect())
    assert taken.count(1) == 0 and taken.count(4) == 0
    every = mixing.Mix(F.lit("all"), F.col("lang"), F.col("source"), budget_tokens=10**9, max_epochs=1)
    assert sorted((r.doc_id or -1) for r in mixing.Mixed(df, every).decisions().collect()) == [-1, 1, 1, 3, 4]
    assert mixing.Mixed(df.limit(0), mix).decisions().count() == 0


# --- the pipeline


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from versionlog.llm.queries import TOKENIZER, WEIGHTS as MIX, DOMAINS

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema if name != "bpe_codec" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        steps[name] = docs.collect()
        if name != "bpe_codec":
            assert docs.columns == columns
    kept = [(r.doc_id, r.text) for r in steps["quality_classifier"]]
    best = {}
    for k, t in kept:
        key = t.translate(LOW)
        best[key] = max(best.get(key, -1), k)
    assert sorted(r.doc_id for r in steps["exact_dedup"]) == sorted(best.values())
    single = [(r.doc_id, r.text) for r in steps["exact_dedup"]]
    u = linked(single, 5, 80)
    assert sorted(r.doc_id for r in steps["ngram_join"]) == sorted(k for k, _ in single if u.find(k) == k)
    rows = [(r.doc_id, DOMAINS[int(r.source[3:]) % 4], r.lang, r.source, r.text) for r in steps["ngram_join"]]
    total = sum(len(words(r[4])) for r in rows)
    assert sorted(r.doc_id for r in steps["mixing"]) == sorted(k for k, _ in mixed(rows, MIX, total, 4))
    library = Tokenizer.from_file(TOKENIZER)
    texts = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in steps["mixing"]}
    assert len(steps["bpe_codec"]) == len(steps["mixing"])
    assert all(r.n_tokens == len(texts[r.doc_id]) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, texts[r.doc_id])).encode()).hexdigest() for r in steps["bpe_codec"])


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    prose = [" ".join(other_words(np.random.default_rng(k), 80)) for k in range(6)]
    rows = [(k, t, "en", f"src{k % 3}") for k, t in enumerate(prose)]
    rows += [(None, prose[0].upper(), "en", "src0"), (0, prose[0], "en", "src0"), (7, None, None, None), (8, "", None, "src1"), (7, prose[1] + " end", "en", None), (9, "word " * 50_000, "de", "odd")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id string, __keep string, epoch string, leaf int, N_TOKENS int"
    docs = spark.createDataFrame([(*r, None, "c", "k", "e", 1, 2) for r in rows], kind)
    for table in (docs, docs.limit(0)):
        n = None
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            if name != "bpe_codec":
                assert out.columns == docs.columns, name
                table = spark.createDataFrame(out.collect(), docs.schema)
                if name == "quality_classifier":
                    table = table if table.isEmpty() else docs  # whatever it thinks of such texts, the others see them all
                n = table.count()
                if name == "exact_dedup" and n:
                    left = {(r.doc_id, r.text) for r in table.collect()}
                    assert (0, prose[0]) in left and (None, prose[0].upper()) not in left and (8, "") in left and (7, None) not in left and len(left) == n == 9
                if name == "ngram_join" and n:
                    assert {r.doc_id for r in table.collect()} == {0, 1, 2, 3, 4, 5, 8, 9}
            else:
                assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == n
