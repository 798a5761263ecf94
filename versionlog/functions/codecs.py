"""Byte codecs as column functions; only wide columns need Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

U64 = "decimal(20,0)"
U64_MAX = (1 << 64) - 1


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast(U64)


def _digits(number: Column) -> Column:
    return F.lpad(F.conv(number.cast(U64).cast("string"), 10, 16), 16, "0")


def _turned(digits: Column) -> Column:
    """Bytes the other way round.  It names its argument once: what it is made of is not computed again for each byte."""
    return F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")


def decode_u64le(value: Column) -> Column:
    """Eight little-endian bytes as DECIMAL(20,0); null for any other length."""
    return F.when(F.length(value) == 8, _number(_turned(F.hex(value))))


def encode_u64le(number: Column) -> Column:
    return F.unhex(_turned(_digits(number)))


def encode_u64ts(ts: Column) -> Column:
    """A timestamp as eight inverted big-endian bytes, so that newer ones sort first."""
    return F.unhex(_digits(F.lit(str(U64_MAX)).cast(U64) - ts.cast(U64)))


def decode_u64ts(raw: Column) -> Column:
    return F.when(F.length(raw) == 8, (F.lit(str(U64_MAX)).cast(U64) - _number(F.hex(raw))).cast(U64))


def append_timestamp(key: Column, ts: Column) -> Column:
    return F.concat(key, encode_u64ts(ts))


def strip_timestamp(key: Column) -> Column:
    """The user key; a key shorter than a timestamp is returned as it is."""
    return F.when(F.length(key) >= 8, F.substring(key, F.lit(1), F.length(key) - 8)).otherwise(key)


def timestamp_of(key: Column) -> Column:
    """The timestamp of a key, null where it has none."""
    return F.when(F.length(key) >= 8, decode_u64ts(F.substring(key, F.length(key) - 7, F.lit(8))))


def append_expiry_base(value: Column, created_at: Column) -> Column:
    """A value with its creation second behind it."""
    return F.concat(value, encode_u64le(created_at.cast(U64)))


def created_at_of(value: Column) -> Column:
    return F.when(F.length(value) >= 8, _number(_turned(F.hex(F.substring(value, -8, 8))))).cast("long")


def strip_expiry_base(value: Column) -> Column:
    """A value of fewer than eight bytes carries no second and is returned as it is."""
    return F.when(F.length(value) >= 8, F.substring(value, F.lit(1), F.length(value) - 8)).otherwise(value)


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def from_hex(text: Column) -> Column:
    return F.unhex(text)


# --- wide columns: a count, then name and value with their lengths, all lengths as varints, by name


def _put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _get_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(raw):
            raise ValueError("wide columns end too early")
        n |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return n, at


def pack_columns(columns: dict[bytes, bytes]) -> bytes | None:
    if not columns:
        return None
    out = bytearray()
    _put_varint(out, len(columns))
    for name in sorted(columns):
        for part in (name, columns[name] or b""):
            _put_varint(out, len(part))
            out += part
    return bytes(out)


def unpack_columns(raw: bytes | None) -> dict[bytes, bytes]:
    if not raw:
        return {}
    count, at = _get_varint(raw, 0)
    parts = []
    for _ in range(2 * count):
        n, at = _get_varint(raw, at)
        if at + n > len(raw):
            raise ValueError("wide columns end too early")
        parts.append(raw[at : at + n])
        at += n
    return dict(zip(parts[::2], parts[1::2]))


def _arrow(fn, kind: pa.DataType, sql: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(map(fn, batch.to_pylist()), kind)

    return F.arrow_udf(run, sql, ArrowUDFType.SCALAR_ITER)


def encode_wide(columns: Column) -> Column:
    """MAP<BINARY,BINARY> as bytes; an empty map is null."""
    return _arrow(lambda m: pack_columns(dict(m)) if m else None, pa.binary(), "binary")(columns)


def decode_wide(raw: Column) -> Column:
    """Bytes as MAP<BINARY,BINARY>; null is an empty map, cut bytes are an error."""
    return _arrow(lambda r: list(unpack_columns(r).items()), pa.map_(pa.binary(), pa.binary()), "map<binary,binary>")(raw)
