"""Connected components of a table of links, by alternating stars.

Each round sends every node's larger neighbours to its smallest neighbour, then
every node's smaller neighbours likewise; after a number of rounds that grows
with the logarithm of the longest chain each node points at the smallest of its
component.  Rounds are written to the shared folder; nothing meets on the driver
but two sums that tell whether a round changed anything.  The least neighbours are
summed before their shuffle and written too, so that adaptive execution can split
the join that carries the neighbours of a hub.  Up to ``AT_ONCE`` links are searched
by one task instead, as rounds of so few rows take far longer to start than to run.

Defined results: a link with a null side or of a node with itself is none; repeated
links and both directions of a link count once; no links give an empty table; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.sources.scratch import remove, stored_at

#: So many links, repeated ones counted, fit well in one task: 16 bytes each, and some times as much while it runs.
AT_ONCE = 250_000


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that has a link and is not the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while len(a):
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
        a, b = least[a], least[b]
        a, b = a[a != b], b[a != b]
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def _at_once(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches if len(b)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_of(*map(np.concatenate, zip(*held)))], ["node", "component"])

    return stored_at(links.coalesce(1).mapInArrow(run, "node long, component long"), "links")[0]


def _large(edges: DataFrame) -> tuple[DataFrame, str]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, path = stored_at(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), path


def _small(edges: DataFrame) -> tuple[DataFrame, str]:
    least, path = stored_at(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    onward = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.unionByName(least.select("u", F.col("m").alias("v"))), path


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v: long) -> a row (node, component) for every node that has a link and is not the smallest of its component."""
    spark = links.sparkSession
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if links.count() <= AT_ONCE:
        return _at_once(links)
    edges, path = stored_at(links.distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        large, one = _large(edges)
        small, other = _small(large.distinct())
        edges, next_ = stored_at(small.distinct(), "links")
        remove(spark, path, one, other)  # a round reads the one before it alone
        before, path = now, next_
