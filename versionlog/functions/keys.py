"""Prefixes and orders of keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


#: An order of keys, as an expression of the key.
Order = Callable[[Column], Column]


@dataclass(frozen=True)
class Prefix:
    """A prefix function and the keys that it is defined for."""

    of: Callable[[Column], Column]
    domain: Callable[[Column], Column]


def fixed(n: int) -> Prefix:
    """The first n bytes of keys that have as many; n below 1 counts as 1."""
    n = max(1, n)
    return Prefix(lambda k: F.substring(k, 1, n), lambda k: F.length(k) >= n)


def capped(n: int) -> Prefix:
    """The first n bytes, or all of a shorter key."""
    return Prefix(lambda k: F.substring(k, 1, n), lambda k: k.isNotNull())


def whole() -> Prefix:
    return Prefix(lambda k: k, lambda k: k.isNotNull())


def timestamped_order(key: str = "key", ts: str = "ts", reverse: bool = False) -> list[Column]:
    """User keys ascending (or descending), of each the newest timestamp first."""
    return [F.col(key).desc() if reverse else F.col(key).asc(), F.col(ts).desc()]


def sort_key(order: Order | None, key: Column | None = None) -> Column:
    """What a key is compared by: itself, or an expression of it whose own order is the one wanted."""
    key = F.col("key") if key is None else key
    return key if order is None else order(key)
