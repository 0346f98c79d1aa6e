"""Structured Streaming jobs: idempotent ingest, windowed top prints, timelines, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.sources import store


def distinct_notices(notices: DataFrame, late: str = "30 days") -> DataFrame:
    """A stream of (notice_hash, announced_at, ...) without repeats; the state of a hash is
    dropped when the watermark has passed it."""
    return notices.withWatermark("announced_at", late).dropDuplicatesWithinWatermark(["notice_hash"])


def largest_prints(prints: DataFrame, width: str = "10 minutes", late: str | None = None) -> DataFrame:
    """(start, prints, premium, event_id) of each tumbling window, of a stream or a table;
    prints later than the watermark are dropped."""
    p = prints.withWatermark("ts", late) if late else prints
    premium = F.round(F.col("value") * F.col("size"), 4)
    g = p.withColumn("premium", premium).groupBy(F.window("ts", width).alias("w"))
    g = g.agg(F.count("*").alias("prints"), F.max("premium").alias("top"), F.max_by("event_id", F.struct("premium", "event_id")).alias("event_id"))
    return g.select(F.col("w.start").alias("start"), "prints", F.col("top").alias("premium"), "event_id")


def upsert_into(path: str, keys: list[str], part: Column | None = None, order: str | None = None):
    """A foreachBatch function that folds each batch into the table at ``path``: only the
    parts that a batch touches are rewritten, the manifest comes last, and a batch seen
    again changes nothing."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, path, keys, batch_id, part, order)

    return fold
