"""Event-time windows over event tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """The frame with a timestamp that watermarks accept; one without a zone is read as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, width: str, by: list[str], ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """(window_start, by..., n, total): events and the sum of their values in windows of a fixed width."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    out = rows.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, by: list[str], ts: str = "ts", watermark: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, watermark) if watermark else events
    out = rows.groupBy(F.window(ts, width, step), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: list[str], ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """(session_start, session_end, by..., n): events that follow each other within a gap."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    out = rows.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")


def topic(stream: DataFrame, name: str, column: str = "topic") -> DataFrame:
    """The events of one topic."""
    return stream.where(F.col(column) == name)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """The first event of each key; keys are remembered for a time only."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
