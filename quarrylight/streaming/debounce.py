"""Streaming forms: gap windows per key with in-window dedupe, and running vote counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, ts: str, text: str, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Session windows of ``gap`` by key with items and distinct items; the watermark is new behaviour."""
    base = events.withWatermark(ts, late) if events.isStreaming else events
    return base.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("items"), F.size(F.collect_set(F.sha1(F.col(text)))).alias("texts")).select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "items", "texts")


def vote_counters(votes: DataFrame, key: str, helpful, noisy, ts: str) -> DataFrame:
    """helpful, noisy and last time by key; works on a stream in update mode."""
    return votes.groupBy(key).agg(F.sum(F.when(helpful, 1).otherwise(0)).alias("helpful"), F.sum(F.when(noisy, 1).otherwise(0)).alias("noisy"), F.max(ts).alias("last"))
