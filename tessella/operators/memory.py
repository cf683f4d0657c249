"""Memory tiers as queries: semantic facts, long-term entries, episodes, short-term and working memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def facts(rows: DataFrame, subjects: list[str] | None = None, predicates: list[str] | None = None, least_confidence: float = 0.0, limit: int = 100) -> DataFrame:
    """Facts of these subjects and predicates with enough confidence, the surest first."""
    if subjects:
        rows = rows.where(F.col("subject").isin(subjects))
    if predicates:
        rows = rows.where(F.col("predicate").isin(predicates))
    return rows.where(F.col("confidence") >= least_confidence).orderBy(F.desc("confidence"), "id").limit(limit)


def graph_of(rows: DataFrame) -> DataFrame:
    """(src, dst, kind): the edge of every fact whose object is a text."""
    return rows.where(F.col("object").isNotNull()).select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("kind"))


def long_term(rows: DataFrame, ids: list | None = None, created_from=None, created_to=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Entries by falling creation time, all given conditions honoured."""
    if ids:
        rows = rows.where(F.col("id").isin(ids))
    if created_from is not None:
        rows = rows.where(F.col("created_at") >= F.lit(created_from))
    if created_to is not None:
        rows = rows.where(F.col("created_at") <= F.lit(created_to))
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def newest(rows: DataFrame, key: str = "id") -> DataFrame:
    """The newest entry of each id."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "created_at").alias("e")).select(key, "e.*")


def alive(rows: DataFrame, now: Column, ttl_seconds: int, stamp: str = "created_at") -> DataFrame:
    """Entries that are no older than their time to live."""
    return rows.where(F.timestamp_diff("SECOND", F.col(stamp), now) <= ttl_seconds)


def within_capacity(rows: DataFrame, capacity: int, order: list) -> DataFrame:
    """The first ``capacity`` entries in this order."""
    return rows.orderBy(*order).limit(capacity)


def working_set(rows: DataFrame, now: Column, ttl_seconds: int = 300, capacity: int = 1024) -> DataFrame:
    """Live entries, the most accessed ones if there are too many."""
    return within_capacity(alive(rows, now, ttl_seconds, "accessed_at"), capacity, [F.desc("accesses"), "key"])


def to_consolidate(rows: DataFrame, now: Column, least_importance: float, age_seconds: int) -> DataFrame:
    """Short-term entries important and old enough to be kept."""
    return rows.where((F.col("importance") >= least_importance) & (F.timestamp_diff("SECOND", F.col("created_at"), now) >= age_seconds))


def latest_value(log: DataFrame, key: str, seq: str, value: str, deleted: str | None = None) -> DataFrame:
    """(key, value): the newest entry of each key in a log; deleted keys are left out."""
    fields = [value] + ([deleted] if deleted else [])
    last = log.groupBy(key).agg(F.max_by(F.struct(*fields), seq).alias("e")).select(key, *(f"e.{f}" for f in fields))
    return last.where(~F.col(deleted)).drop(deleted) if deleted else last


def range_scan(table: DataFrame, key: str, low, high) -> DataFrame:
    """Rows with low <= key <= high by key; empty if low is above high."""
    return table.where(F.col(key).between(F.lit(low), F.lit(high))).orderBy(key)


def longest_prefix(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, prefix): the longest term that each asked word begins with, by an equality join on its beginnings of the lengths that terms have.

    Null words and terms never match; an empty term is a prefix of every word;
    repeated words give one row.
    """
    known = terms.select(F.col("term").alias("prefix")).where("prefix is not null").distinct()
    lengths = known.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row
    words = asked.select("word").where("word is not null").distinct().join(F.broadcast(lengths))
    fitting = F.filter("lengths", lambda n: n <= F.length("word"))
    begins = words.select("word", F.explode(F.transform(fitting, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("prefix"))
    found = begins.join(known, "prefix")
    return found.groupBy("word").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def postings(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(term, key, tf, positions) of an inverted index; positions count from 0."""
    each = docs.select(key, F.posexplode(words).alias("position", "term"))
    return each.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def tf_idf(index: DataFrame, key: str, documents: int) -> DataFrame:
    """(term, key, tf, df, idf, weight): idf is ln(N / df)."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    joined = index.join(df, "term").withColumn("idf", F.log(F.lit(float(documents)) / F.col("df")))
    return joined.select("term", key, "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("weight"))


def with_all_terms(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys whose documents have all of the terms."""
    wanted = list(dict.fromkeys(terms))
    return index.where(F.col("term").isin(wanted)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key)


def top_terms(index: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent terms of each document, ties by term."""
    w = Window.partitionBy(key).orderBy(F.desc("tf"), "term")
    return index.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "term", "tf")


def keys_with_prefix(terms: DataFrame, prefix: str) -> DataFrame:
    """Terms that begin with a string, in order."""
    return terms.where(F.col("term").startswith(prefix)).select("term").distinct().orderBy("term")
