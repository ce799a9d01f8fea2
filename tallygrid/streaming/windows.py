"""Windowed summaries, deduplication and late-event accounting.

Each function takes a batch or a streaming frame. Counts and sums combine on the
map side, so a hot event type is folded before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def event_time(events: DataFrame, column: str = "timestamp", delay: str | None = None) -> DataFrame:
    """A watermark needs a timestamp with time zone; a delay applies to streams only."""
    timed = events.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, delay) if delay and timed.isStreaming else timed


def _summary(events: DataFrame, bucket: Column, value: str, delay: str | None, column: str) -> DataFrame:
    return event_time(events, column, delay).groupBy(bucket.alias("bucket"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"), F.max(value).alias("largest"))


def daily_summary(events: DataFrame, value: str = "value", delay: str | None = "1 day", column: str = "timestamp") -> DataFrame:
    out = _summary(events, F.window(column, "1 day"), value, delay, column)
    return out.select(F.to_date("bucket.start").alias("period_start"), "event_type", "events", "total", "largest")


def weekly_summary(events: DataFrame, value: str = "value", delay: str | None = "1 day", column: str = "timestamp") -> DataFrame:
    """Weeks start on Monday: the epoch was a Thursday, so windows shift by four days."""
    out = _summary(events, F.window(column, "7 days", "7 days", "4 days"), value, delay, column)
    return out.select(F.to_date("bucket.start").alias("period_start"), "event_type", "events", "total", "largest")


def monthly_report(events: DataFrame, value: str = "value", delay: str | None = "1 day", column: str = "timestamp") -> DataFrame:
    """Months have no fixed length, so the month is a plain key: run it in update mode."""
    out = _summary(events, F.trunc(F.to_date(column), "month"), value, delay, column)
    return out.select(F.col("bucket").alias("period_start"), "event_type", "events", "total", "largest")


def dedupe_events(events: DataFrame, key: str = "event_id", column: str = "timestamp", delay: str = "1 day") -> DataFrame:
    """One row per event id: within the watermark on a stream, the earliest row in a batch."""
    timed = event_time(events, column, delay)
    if timed.isStreaming:
        return timed.dropDuplicatesWithinWatermark([key])
    rest = [c for c in timed.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(column, *[c for c in rest if c != column])).alias("_first")
    return timed.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def late_events(batch: DataFrame, latest: Column, delay: str, column: str = "timestamp") -> DataFrame:
    """Rows a stateful operator would drop: older than the latest time seen before, less the delay."""
    return batch.where(F.col(column).cast("timestamp") < latest - F.expr(f"INTERVAL {delay}"))
