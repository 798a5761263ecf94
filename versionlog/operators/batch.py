"""Write batches: operations in call order, savepoints, rows of a log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.model import DELETE, MERGE, OPLOG, PUT, RANGE_DELETE, SINGLE_DELETE, WIDE_ENTITY, InvalidInput, NoMergeOperator


@dataclass
class WriteBatch:
    """Operations as (cf_id, key, op, value, end_key, ts); reusable after ``clear``."""

    has_merge_operator: bool = True
    operations: list[tuple] = field(default_factory=list)
    savepoints: list[int] = field(default_factory=list)
    log_data: list[bytes] = field(default_factory=list)

    def _add(self, op: int, key: bytes, value: bytes | None = None, end: bytes | None = None, cf: int = 0, ts: int | None = None) -> WriteBatch:
        if key is None or (op == RANGE_DELETE and end is None):
            raise InvalidInput("a key is missing")
        self.operations.append((cf, key, op, value, end, ts))
        return self

    def put(self, key: bytes, value: bytes, cf: int = 0, ts: int | None = None) -> WriteBatch:
        return self._add(PUT, key, value, cf=cf, ts=ts)

    def delete(self, key: bytes, cf: int = 0, ts: int | None = None) -> WriteBatch:
        return self._add(DELETE, key, cf=cf, ts=ts)

    def single_delete(self, key: bytes, cf: int = 0) -> WriteBatch:
        return self._add(SINGLE_DELETE, key, cf=cf)

    def delete_range(self, start: bytes, end: bytes, cf: int = 0) -> WriteBatch:
        """[start, end); start at or after end covers nothing."""
        return self._add(RANGE_DELETE, start, end=end, cf=cf)

    def merge(self, key: bytes, operand: bytes, cf: int = 0) -> WriteBatch:
        if not self.has_merge_operator:
            raise NoMergeOperator("a merge needs an operator")
        return self._add(MERGE, key, operand, cf=cf)

    def put_entity(self, key: bytes, packed: bytes, cf: int = 0) -> WriteBatch:
        return self._add(WIDE_ENTITY, key, packed, cf=cf)

    def put_log_data(self, blob: bytes) -> WriteBatch:
        """A note that goes with the batch and takes no sequence number."""
        self.log_data.append(blob)
        return self

    def append(self, other: WriteBatch) -> WriteBatch:
        self.operations += other.operations
        return self

    def clone(self) -> WriteBatch:
        return WriteBatch(self.has_merge_operator, list(self.operations), list(self.savepoints), list(self.log_data))

    def clear(self) -> WriteBatch:
        self.operations, self.savepoints, self.log_data = [], [], []
        return self

    def set_savepoint(self) -> None:
        self.savepoints.append(len(self.operations))

    def rollback_to_savepoint(self) -> None:
        if not self.savepoints:
            raise InvalidInput("no savepoint")
        del self.operations[self.savepoints.pop() :]

    def pop_savepoint(self) -> None:
        if not self.savepoints:
            raise InvalidInput("no savepoint")
        self.savepoints.pop()

    def __len__(self) -> int:
        return len(self.operations)

    def has(self, op: int) -> bool:
        return any(o[2] == op for o in self.operations)

    def iterate(self, handler) -> None:
        """Call ``handler(cf_id, key, op, value, end_key)`` for each operation in order."""
        for cf, key, op, value, end, _ in self.operations:
            handler(cf, key, op, value, end)

    def rows(self, first_seq: int) -> list[tuple]:
        from decimal import Decimal

        return [(cf, key, first_seq + k, op, value, end, first_seq, k, None if ts is None else Decimal(ts)) for k, (cf, key, op, value, end, ts) in enumerate(self.operations)]

    def to_log(self, spark: SparkSession, first_seq: int) -> DataFrame:
        return spark.createDataFrame(self.rows(first_seq), OPLOG)


def batch_summary(log: DataFrame) -> DataFrame:
    """A row for each batch: count and which operations it has."""
    kinds = {"puts": PUT, "deletes": DELETE, "single_deletes": SINGLE_DELETE, "merges": MERGE, "range_deletes": RANGE_DELETE}
    return log.groupBy("batch_seq").agg(F.count("*").alias("n_ops"), *[F.count_if(F.col("op") == op).alias(f"n_{k}") for k, op in kinds.items()], F.max("seq").alias("last_seq"))
