"""Seven analytical questions over an event table, an object table and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import vectors as V

BASE = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2}
VERDICT = 0.7


def _severity(n: Column) -> Column:
    return F.when(n > 100, "high").when(n > 10, "medium").otherwise("low")


def what_changed(events: DataFrame, kind: str = "event_type", ts: str = "timestamp", since=None, until=None) -> DataFrame:
    """(kind, n, total, confidence, severity): events of each type within the bounds, both included."""
    rows = events
    if since is not None:
        rows = rows.where(F.col(ts) >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col(ts) <= F.lit(until))
    counts = rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return counts.join(F.broadcast(total)).select("kind", "n", "total", F.when(F.col("total") > 0, 0.95).otherwise(0.5).alias("confidence"), _severity(F.col("total")).alias("severity"))


def why(events: DataFrame, links: DataFrame, subject: str, most: int = 5) -> DataFrame:
    """(evidence, detail, ord): the subject's first events by version and the links that it has, both ends."""
    own = events.where(F.col("aggregate_id") == subject).orderBy("version").limit(most).select(F.lit("event").alias("evidence"), F.concat_ws(":", F.col("version").cast("string"), "event_type").alias("detail"), F.col("version").cast("long").alias("ord"))
    linked = links.where((F.col("source_id") == subject) | (F.col("target_id") == subject)).select(F.lit("link").alias("evidence"), F.concat_ws(">", "source_id", "target_id").alias("detail"), F.lit(0).cast("long").alias("ord"))
    return own.unionByName(linked)


def _scored(kinds: DataFrame) -> DataFrame:
    """Rows (kind, n_events, n_links) with their score."""
    low = F.lower("kind")
    base = F.lit(0.3)
    for name, value in BASE.items():
        base = F.when(low == name, value).otherwise(base)
    score = F.least(F.lit(1.0), base + F.log1p(F.col("n_events")) / 10 + F.log1p(F.col("n_links")) / 5)
    return kinds.withColumn("score", score)


def impact(kinds: DataFrame, most: int = 10) -> DataFrame:
    """(kind, n_events, n_links, score) with the largest scores, of rows (kind, n_events, n_links)."""
    return _scored(kinds).orderBy(F.desc("score"), "kind").limit(most)


def risky(kinds: DataFrame, most: int = 10) -> DataFrame:
    """As ``impact``, with findings counting half as much again and monitoring three tenths more, 1 at most."""
    factor = F.when(F.lower("kind") == "finding", 1.5).when(F.lower("kind") == "monitoring", 1.3).otherwise(1.0)
    return _scored(kinds).withColumn("score", F.least(F.lit(1.0), F.col("score") * factor)).orderBy(F.desc("score"), "kind").limit(most)


def to_investigate(objects: DataFrame, investigations: DataFrame, label: str = "label") -> DataFrame:
    """Objects that no investigation names."""
    return objects.join(investigations.select(F.col("title").alias(label)), label, "left_anti")


def similarity_score(label_a: Column, label_b: Column, words_a: Column, words_b: Column) -> Column:
    """0.4 of the labels' and 0.6 of the contents' Jaccard similarity."""
    return 0.4 * V.jaccard(label_a, label_b) + 0.6 * V.jaccard(words_a, words_b)


def what_is_similar(objects: DataFrame, subject, least: float = 0.1, most: int = 10) -> DataFrame:
    """(id, score) of objects (id, label_words, words) above ``least`` to one of them, the best first."""
    one = objects.where(F.col("id") == F.lit(subject)).select(F.col("label_words").alias("_l"), F.col("words").alias("_w")).limit(1)
    score = similarity_score(F.col("label_words"), F.col("_l"), F.col("words"), F.col("_w"))
    rows = objects.where(F.col("id") != F.lit(subject)).join(F.broadcast(one)).select("id", score.alias("score"))
    return rows.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(most)


def verdict(confidence: Column) -> Column:
    return F.when(confidence >= VERDICT, "supported").otherwise("uncertain")
