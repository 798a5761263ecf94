"""Wide-column entities: MAP<BINARY,BINARY> values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_entities(rows: DataFrame) -> DataFrame:
    """Rows (cf_id, key, seq, columns) -> one entity a key; of each column the newest value.

    Columns are exploded and aggregated, so one entity with many writes is combined before
    the shuffle.
    """
    cells = rows.select("cf_id", "key", "seq", F.explode("columns").alias("name", "value"))
    newest = cells.groupBy("cf_id", "key", "name").agg(F.max(F.struct("seq", "value")).alias("v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("name"), F.col("v.value").alias("value"))))
    return newest.groupBy("cf_id", "key").agg(F.map_from_entries(entries).alias("columns"), F.max("v.seq").alias("seq"))


def column(columns: Column, name: bytes | str) -> Column:
    """One column's value, null if the entity lacks it."""
    return F.try_element_at(columns, F.lit(name.encode() if isinstance(name, str) else name))


def project(entities: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as columns of the table."""
    return entities.select("cf_id", "key", *[column(F.col("columns"), n).alias(n) for n in names])


def by_name(columns: Column) -> Column:
    """Entries in order of their names."""
    return F.array_sort(F.map_entries(columns))
