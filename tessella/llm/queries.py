"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import bpe, decontam, maintext, media, quotes, rollup, simhash, sstable, toxicity, warc
from tessella.llm.store import fresh_path, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after all documents were inserted, exact copies deleted, and other languages than English counted anew with another vocabulary."""
    first_version, second_version = "byte_bpe_50k", "byte_bpe_multi_50k"
    paths = {first_version: public_tokenizers.path("byte_bpe_50k.json"), second_version: public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    docs = rollup.counted(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), paths, public_tokenizers.PATTERN)
    slim = written(docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("digest"), F.sha2("text", 256).alias("sha"), *paths), "rollup")
    first = written(slim.groupBy("digest", "sha").agg(F.min("doc_id").alias("first")).withColumnsRenamed({"digest": "d", "sha": "s"}), "rollup")
    marked = written(slim.join(first, (slim.digest == first.d) & slim.sha.eqNullSafe(first.s)).withColumn("copy", F.col("doc_id") != F.col("first")), "rollup")

    def rows(df: DataFrame, version: str) -> DataFrame:
        return df.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(f"`{version}`").alias("n_tokens"))

    totals = rollup.Rollup(spark, fresh_path(spark, "totals"))
    copies = rollup.deleted(rows(marked.where("copy"), first_version))
    others = marked.where("not copy and lang <> 'en'")
    totals.apply("0001-insert", rollup.inserted(rows(marked, first_version)))
    totals.apply("0002-copies", copies)
    totals.apply("0003-vocabulary", rollup.revised(rows(others, first_version), rows(others, second_version)))
    totals.apply("0002-copies", copies)  # a retry, which changes nothing
    totals.compact()
    return totals.totals()


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document in sorted-string-table shards, read back."""
    path = fresh_path(spark, "sstable")
    manifest = sstable.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    entries = sstable.read(manifest, path)
    return entries.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of every whole document and the components of those within four bits."""
    found = simhash.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of conversations that quote, without its quotations, with the message that it answers and its place among the replies.

    The table's messages hold no quotations, so ``quotes.quoting`` puts them there: each turn quotes an earlier one, with what that one quotes. Every row of the table is a message.
    """
    found = quotes.linked(quotes.quoting(_table(spark, sf_dir, "conversations"), every=True))
    return found.select("conv_id", "turn", "role", "parent", "linked", "quoted_passages", "thread", "reply", "depth", F.col("own").alias("text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every whole document."""
    return decontam.report(decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, read back from the archives."""
    path = fresh_path(spark, "warc")
    manifest = warc.write(_table(spark, sf_dir, "pages"), path)
    records = warc.read(manifest, path, payloads=False)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document after its disguised words are restored."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, *toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "hits", "words")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as a progressive JPEG, read back, and its tensor's features."""
    stored = written(media.store_texts(_table(spark, sf_dir, "documents")), "media")
    found = media.features(media.tensors(stored, payload=True))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole document, decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return maintext.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_media": op3_media,
    "op4_bpe": op4_bpe,
    "op5_rollup": op5_rollup,
    "op6_sstable": op6_sstable,
    "op7_simhash": op7_simhash,
    "op8_quotes": op8_quotes,
    "op9_decontaminate": op9_decontaminate,
    "op10_maintext": op10_maintext,
}
SQL: dict[str, str] = {
    "op1_warc": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                     min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
              FROM pages)""",
    "op9_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM b WHERE len(w) > 0),
        g AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS gram FROM i),
        p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
        h AS (SELECT DISTINCT doc_id, pos, p.k, item_id FROM p JOIN g ON g.k = p.k AND g.gram = array_to_string(list_slice(w, pos, pos + p.k - 1), ' ')),
        n AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS word FROM h) GROUP BY 1),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    # The markup of the supplied pages only: an article element of headings and paragraphs.
    "op10_maintext": r"""
        WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<h1>|</h1>|<p>|</p>') AS parts FROM pages),
        b AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"'), '&amp;?', chr(1), 'g'), chr(1), '&'), '[ \t\n\r\f\x0B]+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a)
        SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10))) AS n_chars FROM b""",
}
