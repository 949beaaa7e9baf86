"""STRM-3: session activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rollup(ts: str) -> list:
    return [F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("events")]


def session_activity(events: DataFrame, key: str, ts: str, watermark: str | None = None,
                     gap_seconds: int | None = None) -> DataFrame:
    """First and last event and event count per key, or per session when a gap is given.

    A session ends when the next event comes ``gap_seconds`` or more later.
    """
    if gap_seconds is None:
        return events.groupBy(key).agg(*_rollup(ts))
    if events.isStreaming:
        watched = events.withWatermark(ts, watermark or f"{gap_seconds} seconds")
        window = F.session_window(ts, f"{gap_seconds} seconds").alias("w")
        return watched.groupBy(key, window).agg(*_rollup(ts)).drop("w")
    return _batch_sessions(events, key, ts, gap_seconds)


def _batch_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Events of one gap-long slot always share a session, so slots are aggregated first
    (before the shuffle) and only slots are put in order: a key that owns a third of the
    events still has one row per slot of time."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    slots = events.groupBy(key, F.floor(seconds / gap_seconds).alias("_slot")).agg(*_rollup(ts))
    order = Window.partitionBy(key).orderBy("_slot")
    break_at = F.lag("last_at").over(order) + F.make_dt_interval(secs=F.lit(gap_seconds))
    opened = slots.withColumn("_opens", F.coalesce((F.col("first_at") >= break_at).cast("int"), F.lit(0)))
    numbered = opened.withColumn("_n", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_n").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.sum("events").alias("events")).drop("_n")
