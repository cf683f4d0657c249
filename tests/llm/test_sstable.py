"""Shards against the tokenizers library; lookups, filters and ranges."""

from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import sstable
from tessella.llm.store import fresh_path, ranged

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def _entries(spark, docs, **options):
    path = fresh_path(spark, "test")
    manifest = sstable.write(docs, path, PATH, public_tokenizers.PATTERN, **options)
    rows = sstable.read(manifest, path).collect()
    return manifest, path, [(r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rows]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 3, "shard_bytes": 200}])
def test_ids_and_starts_are_those_of_the_library(spark, make_docs, corpus, library, options):
    _, _, found = _entries(spark, make_docs(corpus).repartition(3), **options)
    at = 0
    for (key, start, ids), (i, text) in zip(sorted(found), enumerate(corpus), strict=True):
        assert (key, start, ids) == (i, at, [*library(text), 0])
        at += len(ids)


def test_every_character_class_is_cut_as_the_library_cuts_it(spark, make_docs, library):
    characters = [chr(c) for c in (*range(0x0, 0x250), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x2160, 0x300, 0x1F600)]
    texts = ["".join(f"a{c}b {c}{c} {c}" for c in characters[i:i + 60]) for i in range(0, len(characters), 60)]
    for key, _, ids in _entries(spark, make_docs(texts))[2]:
        assert ids == [*library(texts[key]), 0]


def test_null_and_repeated_keys_come_in_order(spark, make_docs, library):
    rows = [(5, "b"), (None, "n"), (5, "a"), (-3, "m"), (1 << 62, "z")]
    _, _, found = _entries(spark, make_docs(rows), shard_rows=2)
    assert [k for k, _, _ in sorted(found, key=lambda e: e[1])] == [None, -3, 5, 5, 1 << 62]
    assert [ids for k, _, ids in sorted(found, key=lambda e: e[1]) if k == 5] == [[*library("a"), 0], [*library("b"), 0]]


def test_empty_table(spark, make_docs):
    manifest, _, found = _entries(spark, make_docs([]))
    assert manifest.count() == 0
    assert found == []


def test_lookup_reads_what_was_written(spark, make_docs, corpus, library):
    manifest, path, _ = _entries(spark, make_docs(corpus), shard_rows=4)
    keys = spark.createDataFrame([(k,) for k in (5, 13, 999, 13, None, -7, 14)], "doc_id long")
    found = sstable.lookup(manifest, path, keys).collect()
    assert sorted((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in found) == [(k, [*library(corpus[k]), 0]) for k in (5, 13, 14)]


def test_lookup_finds_every_row_of_a_key_over_several_shards(spark, make_docs, library):
    rows = [(5, f"text {i} " * 40) for i in range(9)] + [(k, f"row {k}") for k in range(20)]
    manifest, path, _ = _entries(spark, make_docs(rows), shard_rows=4, shard_bytes=200)
    found = sstable.lookup(manifest, path, spark.createDataFrame([(5,), (6,)], "doc_id long")).collect()
    assert sorted((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in found) == sorted((k, [*library(t), 0]) for k, t in rows if k in (5, 6))


def test_strings_of_special_tokens_get_the_ids_of_the_library(spark, make_docs, library):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n x", "<|endoftext", "a" * 3000 + "<|endoftext|>"]
    found = _entries(spark, make_docs(texts))[2]
    assert found[0][2] == [31373, 220, 50256, 995, 0]
    assert [ids for _, _, ids in sorted(found)] == [[*library(t), 0] for t in texts]


def test_shard_bytes_blocks_and_filter(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 100)
    out = io.BytesIO()
    writer = sstable.ShardWriter(out)
    for k in range(0, 1000, 2):
        writer.add(sstable.key_bytes(k), np.arange(k % 7 * 30_000, k % 7 * 30_000 + 5, dtype=np.uint32))
    writer.close()
    reader = sstable.ShardReader(out, len(out.getvalue()))
    assert len(reader.places) > 10
    assert reader.entries == 500
    assert [sstable.key_number(k) for k, _ in reader] == list(range(0, 1000, 2))
    assert reader.get(sstable.key_bytes(500))[0].tolist() == list(range(500 % 7 * 30_000, 500 % 7 * 30_000 + 5))
    assert sum(reader.may_hold(sstable.key_bytes(k)) for k in range(1, 1000, 2)) < 50
    with pytest.raises(ValueError, match="fall"):
        writer.add(sstable.key_bytes(1), np.empty(0, np.uint32))


def test_same_rows_give_the_same_files(spark, make_docs, corpus):
    digests = [sorted(r.sha256 for r in _entries(spark, make_docs(corpus).repartition(n), shard_rows=6)[0].collect()) for n in (1, 5)]
    assert digests[0] == digests[1]


def test_ranges_follow_keys_however_they_cluster(spark):
    keys = [*range(1000), *(10**15 + i // 3 for i in range(1000)), -(1 << 63), (1 << 63) - 1, *([77] * 500)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    dealt, n = ranged(df, "key", 100)
    rows = dealt.groupBy("range").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert [r.range for r in rows] == sorted(r.range for r in rows) and len(rows) <= n
    assert all(x.b < y.a for x, y in zip(rows, rows[1:], strict=False))
    assert sum(r.n for r in rows) == len(keys)
    assert max(r.n for r in rows) <= 700
    assert dealt.rdd.getNumPartitions() == n


def test_crc_of_entries(spark, make_docs, library):
    _, _, found = _entries(spark, make_docs(["some text"]))
    assert zlib.crc32(np.array(found[0][2], "<u4").tobytes()) == zlib.crc32(np.array([*library("some text"), 0], "<u4").tobytes())
