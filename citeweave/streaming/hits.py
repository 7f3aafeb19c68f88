"""Ranked hits as they arrive: counts and fused scores in windows of event time, late hits dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_hits(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", k: int = 60) -> DataFrame:
    """(start, item, hits, score) of a stream (or table) of ts, item, rank: for each window, how often an item was found,
    and the sum of 1 / (k + rank)."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", window).alias("w"), "item").agg(F.count("*").alias("hits"), F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return out.select(F.col("w.start").alias("start"), "item", "hits", "score")
