"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes the documents that its predecessor kept; all but the last
return the columns of ``documents``, and further columns that the input has.

Defined cases: null and empty texts are no words, so the first stage scores them
as texts without toxic words and the third keeps them; the second takes a null,
an empty and a blank text for copies of one another and keeps the one with the
smallest doc_id; the last encodes them to no ids. doc_ids should be unique: rows
of one doc_id are scored and cleaned row by row, but are kept or dropped
together as copies. Rows with a null doc_id are kept by the second stage. Equal
texts keep the smallest doc_id. Empty tables give empty tables; without labels
of both classes the first stage rejects by the share of toxic labels alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import bpe, decontam, simhash, toxicity
from tessella.llm.store import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, *toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of exact and near copies."""
    return simhash.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, and the digest of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: The model of the first stage and the fingerprints of the second have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
