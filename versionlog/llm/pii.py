"""Personal data: expressions propose, checksums confirm, context words adjust.

Kinds: email, ip, card (Luhn), phone, and beyond these iban (mod 97) and ssn.
A span's score starts at its kind's prior; a context word of the kind nearby
raises it, a word that speaks against the kind lowers it.  Spans of the first
four kinds always stay, with their score; iban and ssn need ``least`` points.

Offsets are code points, the end exclusive.  Within a kind, spans are leftmost
and do not overlap; a match that fails its test is dropped without another try.
All scans take time in proportion to the text, also for one endless word.

Defined results: a null or empty text has no spans; repeated rows are searched
each; an empty table gives an empty table; other columns pass through, and
input columns named like the outputs give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ._io import put, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
RAISE, LOWER, NEAR = 0.3, 0.3, 48

_FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login|addr)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|payment|pay)\b", re.I),
    "phone": re.compile(r"\b(?:phone|call|tel|mobile|fax|contact)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|transfer)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|taxpayer)\b", re.I),
}
_AGAINST = {
    "ip": re.compile(r"\b(?:version|release|section|chapter|build)\b", re.I),
    "card": re.compile(r"\b(?:isbn|order|tracking|serial)\b", re.I),
    "phone": re.compile(r"\b(?:offset|coordinates|sum)\b", re.I),
    "ssn": re.compile(r"\b(?:part|serial|model|order)\b", re.I),
}

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ both ways: an address has exactly one, so none is missed and no run is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _confirmed(pattern: re.Pattern, text: str, test) -> Iterator[tuple[int, int]]:
    return (m.span() for m in pattern.finditer(text) if test(m[0]))


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _card(match: str) -> bool:
    digits = _digits(match)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _ssn(match: str) -> bool:
    area, group, serial = match.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, by kind and then start."""
    if "@" in text:
        yield from (("email", *x) for x in _emails(text))
    if not _DIGIT.search(text):
        return
    yield from (("ip", *x) for x in _confirmed(_IP, text, lambda m: all(map(_byte_part, m.split(".")))))
    yield from (("card", *x) for x in _confirmed(_CARD, text, _card))
    if "+" in text:
        yield from (("phone", *x) for x in _confirmed(_PHONE, text, lambda m: 8 <= len(_digits(m)) <= 15))
    yield from (("iban", *x) for x in _confirmed(_IBAN, text, lambda m: mod97(m.replace(" ", ""))))
    yield from (("ssn", *x) for x in _confirmed(_SSN, text, _ssn))


def spans(text: str, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    out = []
    for kind, start, end in candidates(text):
        around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
        score = PRIOR[kind] + RAISE * bool(_FOR[kind].search(around))
        if kind in _AGAINST and _AGAINST[kind].search(around):
            score -= LOWER
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE_KINDS or score >= least:
            out.append((kind, start, end, score))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find_pii(df: DataFrame, text_col: str = "text", out: str = "pii", least: float = 0.5) -> DataFrame:
    """Add an array of spans (kind, start, end, score) of every whole text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(x.as_py(), least)] for x in batch]
            yield pa.array(rows, pa.list_(_SPAN))

    udf = F.arrow_udf(run, "array<struct<kind string, start long, end long, score double>>", ArrowUDFType.SCALAR_ITER)
    return put(df, {out: udf(text_of(df, text_col))})


def redact(df: DataFrame, text_col: str = "text", pii_col: str = "pii", out: str = "redacted") -> DataFrame:
    """Add the text with every span replaced by its kind in brackets; of overlapping spans the first stays."""
    text, found = text_of(df, text_col), F.coalesce(df[pii_col], F.array().cast(df.schema[pii_col].dataType))
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("s"), (-s["end"]).alias("e"), s["kind"].alias("k"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(text, (done["at"] + 1).cast("int"), (s["s"] - done["at"]).cast("int"))
        more = F.struct((-s["e"]).alias("at"), F.concat(done["text"], between, F.lit("["), s["k"], F.lit("]")).alias("text"))
        return F.when(s["s"] >= done["at"], more).otherwise(done)

    end = F.aggregate(ordered, start, step)
    return put(df, {out: F.concat(end["text"], F.substring(text, (end["at"] + 1).cast("int"), F.lit(2**31 - 1)))})
