"""Structured Streaming forms of the request-driven behaviours: idempotent ingest, latest-wins upserts, rolling caps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ridgeline.sources import VersionedTable


def once_per_fingerprint(stream: DataFrame, fingerprint: str, ts: str, lateness: str = "24 hours") -> DataFrame:
    """Drops repeats of a fingerprint within the lateness; its state is bounded by that."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([fingerprint])


def windowed_counts(stream: DataFrame, who: str, ts: str, window: str = "24 hours", slide: str = "1 hour", lateness: str = "24 hours") -> DataFrame:
    """Rows of each contributor in sliding windows, for caps that may lag by a slide."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, window, slide), F.col(who)).agg(F.count("*").alias("n"))


def upserts(stream: DataFrame, table: VersionedTable, key: str, order: list[str], checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Every micro-batch is merged into the table by key, the last row winning; replaying a batch changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, key, order)
        if then is not None:
            then(batch, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
