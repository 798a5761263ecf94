import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from versionlog.llm import pii, quality_classifier, quality_rules

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = sum(map(int, d[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])
    return total % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


PII = [
    "", "mail a.b+c@x-y.co.uk, or a@b.c@d.e and a@b.c+x@d.e @x.y a@b x@y..z", "hosts 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500 0000 0000 0004 9 1", "call +1 (555) 010-9999 or +49.30.1234567 +1 +12 +1234567890123456789",
    "é4111111111111111é ü a@ü.de ä@b.de", "1" * 5000, "a" * 5000 + "@", "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765431", "ssn 078-05-1120" + " and so on" * 6 + " part 123-45-6789", "+1 555 010 1234 4644348398010899",
]


@pytest.mark.parametrize("text", PII)
def test_base_spans_are_the_plain_expressions(text):
    found = [s[:3] for s in pii.spans(text) if s[0] in pii.BASE_KINDS]
    assert found == base_spans(text)


def test_base_spans_on_random_texts():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        text = "".join(rng.choice(list("ab1234.@+-() 25"), rng.integers(0, 60)))
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == base_spans(text), text


def test_checksums_and_context():
    kinds = [s[0] for s in pii.spans(PII[8])]
    assert kinds == ["iban"]
    assert [s[0] for s in pii.spans(PII[9])] == ["ssn"]
    near, far = pii.spans("call me: +1 555 010 9999")[0], pii.spans("see: +1 555 010 9999")[0]
    assert near[3] > far[3]


def test_pii_operator(spark):
    rows = [(k, t, None) for k, t in enumerate(PII)] + [(1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, PII string")
    out = pii.find_pii(df)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "pii"]
    got = [[(s.kind, s.start, s.end) for s in r.pii] for r in out.collect()]
    assert got == [[s[:3] for s in pii.spans(r[1] or "")] for r in rows]
    for r in pii.redact(out).collect():
        text, want, at = r.text or "", "", 0
        for kind, start, end in sorted([s[:3] for s in pii.spans(text)], key=lambda s: s[1]):
            if start >= at:
                want, at = want + text[at:start] + f"[{kind}]", end
        assert r.redacted == want + text[at:]
    assert pii.find_pii(df.limit(0)).count() == 0


def brute_counts(text):
    words = [m for m in re.findall(r"[^\x20\x09-\x0D]+", text)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


RULES = ["", " \n", "one two three", "a b c a b c\na b c a b c", "é\x85ü\xa0x y\x0bz", "#*$%&|<> # x\nx\n\n \nx", "w " * 300, "lorem " + " ".join(f"w{k * k % 97}q" for k in range(500))]


@pytest.mark.parametrize("text", RULES)
def test_counts(text):
    assert quality_rules.counts(text) == brute_counts(text)


def test_bands():
    press = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    repeated, noise = b"spam " * 1000, np.random.default_rng(0).bytes(5000)
    for raw in (repeated, noise, b""):
        assert not quality_rules.in_bands(len(raw), *quality_rules.ratios(raw, press))


def brute_verdict(text):
    """The bands by their definition: whole ratio by length, chunks of 2,048 bytes from the start and one at the end."""
    raw = text.encode()
    press = lambda x: len(quality_rules.zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    words, *_, repeated = brute_counts(text)
    if words < 50 or 100 * repeated > 50 * words:
        return False
    least, most = [(a, b) for n, a, b in quality_rules.LIMITS if n <= len(raw)][-1]
    chunks = [raw[k : k + 2048] for k in range(0, len(raw), 2048)]
    if len(chunks[-1]) < 2048:
        chunks = chunks[:-1] + [raw[-2048:]] * (len(raw) > 2048)
    odd = sum(1 for c in chunks if not 0.45 <= press(c) <= 0.75)
    return least <= press(raw) <= most and odd <= len(chunks) / 10


def test_band_verdicts_by_brute_force(spark):
    rng = np.random.default_rng(21)
    stock = [a + b for a in ("ver", "lo", "min", "tra", "sel", "qu", "pon") for b in ("ka", "rest", "dil", "umo", "ing", "et", "sa", "ni")]
    prose = lambda n: " ".join(rng.choice(stock, n))
    noise = lambda n: rng.integers(33, 127, n).astype(np.uint8).tobytes().decode()
    texts = [prose(n) for n in (40, 60, 200, 400, 800, 3000)] + [prose(500) + " spam" * 300, prose(700) + " " + noise(1500), noise(3000), prose(60) + " x" * 30]
    texts += [" ".join(f"{prose(1)}{k * 7919 % 1000}" for k in range(n)) for n in (60, 300, 900, 5000)] + RULES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert got == {k: brute_verdict(t) for k, t in enumerate(texts)} and 3 < sum(got.values()) < len(texts) - 5
    # a tail that repeats is seen
    press = quality_rules.zstandard.ZstdCompressor(level=3)
    assert min(quality_rules.ratios(texts[6].encode(), press)[1]) < 0.45


def test_quality_operator(spark):
    rows = [(k, t, "x") for k, t in enumerate(RULES)] + [(None, None, "x"), (0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept string")
    out = quality_rules.judge(df)
    assert [c.lower() for c in out.columns].count("kept") == 1
    got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()]
    want = [brute_counts(r[1] or "") for r in rows]
    assert got == [(*w, w[0] < 50 or 100 * w[4] > 50 * w[0]) for w in want]
    assert quality_rules.judge(df.limit(0)).count() == 0


def corpus(spark, n=400):
    rng = np.random.default_rng(5)
    good = ["the", "river", "and", "house", "green", "walking", "of", "a", "morning", "light"]
    bad = ["WIN!!", "$$$", "click***", "BUY!!", "%%%"]
    rows = []
    for k in range(n):
        junk = k % 5 == 0
        rows.append((k, " ".join(rng.choice(bad if junk else good, 40)), 0 if junk else 1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2 == 0], "doc_id long, quality int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_classifier_parts_held_out_documents(spark):
    docs, labels, truth = corpus(spark)
    drawn = quality_classifier.Resampled(docs, labels, carry=True)
    decided = {r.doc_id: r.kept for r in drawn.decisions().collect()}
    held = [k for k in truth if k % 2]
    assert np.mean([decided[k] == bool(truth[k]) for k in held]) > 0.97
    assert sorted(r.doc_id for r in drawn.kept().collect()) == sorted(k for k, v in decided.items() if v)
    assert drawn.kept().columns == docs.columns


def test_scores_hold_no_documents(spark):
    """Scored twice rather than written: the same documents stay."""
    docs, labels, _ = corpus(spark, 60)
    drawn = quality_classifier.Resampled(docs, labels, carry=True)
    assert set(drawn.scores.columns) == {"__id", "__good", "__fit", "n_grams", "log_weight", "__rank"}
    kept = {r.doc_id for r in drawn.decisions().where("kept").collect()}
    assert sorted(map(tuple, drawn.kept().collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id in kept)


def test_weights_match_plain_models(spark):
    docs, labels, truth = corpus(spark, 60)
    drawn = quality_classifier.Resampled(docs, labels, bits=8)
    texts = {r.doc_id: r.text for r in docs.collect()}
    fit = {r["__label_id"] for r in quality_classifier.labelled(labels).where("__good and __fit").collect()}
    raw, target = np.zeros(256), np.zeros(256)
    for k, t in texts.items():
        c = np.bincount(quality_classifier.grams(t, 8), minlength=256)
        raw += c
        target += c * (k in fit)
    w = np.log((target + 1) / (target.sum() + 256)) - np.log((raw + 1) / (raw.sum() + 256))
    for r in drawn.decisions().collect():
        assert abs(r.log_weight - w[quality_classifier.grams(texts[r.doc_id], 8)].sum()) < 1e-6
    ranked = sorted((r.sample_key for r in drawn.decisions().collect()), reverse=True)
    least = ranked[drawn.k - 1]
    assert all(r.kept == (r.sample_key >= least) for r in drawn.decisions().collect())


def test_threshold_is_the_kth_largest(spark):
    rng = np.random.default_rng(6)
    for values in (rng.integers(-(1 << 40), 1 << 40, 500), rng.integers(0, 5, 100), np.array([7])):
        df = spark.createDataFrame([(int(v),) for v in values], "x long")
        for k in (1, len(values) // 2 or 1, len(values)):
            assert quality_classifier.threshold(df, "x", k) == sorted(values.tolist(), reverse=True)[k - 1]
    assert quality_classifier.threshold(df, "x", 0) is None and quality_classifier.threshold(df.limit(0), "x", 3) is None


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "some words here", 9), (2, "x" * 100_000, 9)], "doc_id long, text string, log_weight int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    drawn = quality_classifier.Resampled(docs, labels, carry=True)
    assert drawn.decisions().count() == 4 and set(drawn.kept().columns) == {"doc_id", "text", "log_weight"}
    rows = drawn.decisions().collect()
    assert drawn.cut == 0.0 and {r.log_weight for r in rows if r.doc_id == 1} == {0.0}
    assert sorted(r.doc_id or -1 for r in drawn.kept().collect()) == sorted(r.doc_id or -1 for r in rows if r.kept)
    assert sum(r.kept for r in rows) >= drawn.k == sum(r.log_weight >= 0 for r in rows)
    nothing = quality_classifier.Resampled(docs.limit(0), labels.limit(0), carry=True)
    assert nothing.decisions().count() == 0 and nothing.kept().count() == 0


def test_digest_columns(spark):
    df = pii.find_pii(spark.createDataFrame([(1, PII[1])], "doc_id long, text string"))
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(PII[1]))
    shown = df.select(F.sha2(F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), 256)).first()[0]
    assert shown == hashlib.sha256(joined.encode()).hexdigest()
