"""The registered queries on the smallest tables: against their SQL, or against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessella.llm import bpe, queries, quotes
from tests.llm.test_rollup_quotes import plain_links
from tests.llm.test_simhash import plain_components, plain_print

DATA = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, DATA).collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    expected = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=str)
    found = rows_of(spark, name)
    assert found and sorted(found[0]) == sorted(names)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in found), key=str) == expected


def test_toxicity(spark, texts):
    found = {r["doc_id"]: r for r in rows_of(spark, "op2_toxicity")}
    assert set(found) == set(texts)
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_media(spark, texts):
    found = rows_of(spark, "op3_media")
    assert len(found) == len(texts)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(64 - len(raw) % 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by_text = {}
    for r in found:
        by_text.setdefault(texts[r["doc_id"]], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def test_bpe(spark, texts):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(spark, "op4_bpe")}
    expected = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        expected[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert found == expected


def test_sstable(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, expected = 0, {}
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        expected[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op6_sstable")} == expected


def test_simhash(spark, texts):
    prints = {i: plain_print(t) for i, t in texts.items()}
    pairs = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4]
    components = plain_components(pairs, list(prints))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op7_simhash")} == {i: (f"{p:016x}", components[i]) for i, p in prints.items()}


def test_quotes(spark):
    composed = {(r.conv_id, r.turn): r.text for r in quotes.quoting(spark.read.parquet(f"{DATA}/conversations.parquet")).collect()}
    expected = plain_links(composed)
    found = {(r["conv_id"], r["turn"]): r for r in rows_of(spark, "op8_quotes")}
    assert {k: (r["parent"], r["linked"], r["thread"], r["reply"], r["depth"]) for k, r in found.items()} == expected
    assert any(r["depth"] > 1 for r in found.values()) and any(r["quoted_passages"] > 1 for r in found.values())
    originals = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    assert all(r["text"] == quotes.own_text(originals[k]) for k, r in found.items())


def test_rollup(spark):
    paths = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    library = Tokenizer.from_file(paths["byte_bpe_50k"])
    ranks = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(paths["byte_bpe_multi_50k"]), special_tokens={})
    expected, seen = {}, set()
    for r in sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r.doc_id):
        if r.text in seen:
            continue
        seen.add(r.text)
        english = r.lang == "en"
        n = len(library.encode(r.text or "", add_special_tokens=False).ids) if english else len(ranks.encode_ordinary(r.text or ""))
        total = expected.setdefault((r.source, r.lang, "byte_bpe_50k" if english else "byte_bpe_multi_50k"), [0, 0])
        total[0] += 1
        total[1] += n
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in rows_of(spark, "op5_rollup")} == expected
