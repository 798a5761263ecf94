"""Counting and timing of what streams do."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class CountingListener(StreamingQueryListener):
    """How often queries started, made progress, idled and ended, and how long their batches took."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()
        self.rows, self.batch_ms = 0, []

    def onQueryStarted(self, event) -> None:
        self.counts["started"] += 1

    def onQueryProgress(self, event) -> None:
        self.counts["progress"] += 1
        self.rows += event.progress.numInputRows
        self.batch_ms.append(event.progress.batchDuration)

    def onQueryIdle(self, event) -> None:
        self.counts["idle"] += 1

    def onQueryTerminated(self, event) -> None:
        self.counts["failed" if event.exception else "ended"] += 1

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, n) for k, n in sorted(self.counts.items())], "event string, n long")


def event_counts(events: DataFrame) -> DataFrame:
    """Events (kind, started_at, ended_at, failed) by kind: number, failures, total and longest time."""
    took = F.col("ended_at") - F.col("started_at")
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"), F.sum(took).alias("total_time"), F.max(took).alias("longest"))
