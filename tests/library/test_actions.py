"""Actions on texts and indexes, resources of pages, files and keys."""

from __future__ import annotations

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import search as S
from tessella.processors import pages, registry as processors
from tessella.queries import searching
from tessella.sources import catalog

DATA = "/root/testdata/sf0.001"


def _act(text, **meta):
    return list(processors.ai_text(text.encode(), meta))


def test_actions_on_a_text():
    assert _act("Mail a@b.org now") == [("entity", "a@b.org", {"kind": "EMAIL", "confidence": "0.95", "start": "5"})]
    assert _act("The api code has an api function.", action="classify") == [("ai.classification", "technical", {"confidence": f"{(3 + 2.5 + 2 * 2.5) / 7:.4f}"})]
    assert _act("", action="classify") == [("ai.classification", "unknown", {"confidence": "0.0000"})]
    assert _act("hello server", action="translate", target_language="es") == [("ai.translation", "hola servidor", {"confidence": "1.0000", "target_language": "es"})]
    assert _act("hello", action="translate") == [("ai.translation", "hello", {"confidence": "0.0000", "target_language": "en"})]
    (kind, value, meta), = _act("Red red blue x", action="embed")
    assert (kind, json.loads(value), meta) == ("ai.embeddings", {"blue": 0.5, "red": 1.0}, {"dimension": "2", "method": "bow"})
    assert _act("", action="embed")[0][1] == "{}"
    assert _act("", action="summarize") == [("ai.summary", "", {"summary_sentences": "0"})]
    assert [name for _, name, _ in _act("", action="models")] == list(processors.MODELS)


def test_unknown_actions_and_bad_bytes_are_error_rows(spark):
    rows = spark.createDataFrame([("1", bytearray(b"x"), "application/x-ai-runtime", {"action": "sing"}), ("2", bytearray(b"\xff"), "application/x-ai-text", {}), ("3", None, "application/x-ai-text", None)], "id string, data binary, content_type string, metadata map<string,string>")
    found = processors.process(rows, ["ai_runtime"]).collect()
    assert sorted((r.id, r.kind) for r in found) == [("1", "processing.error"), ("2", "processing.error")]
    assert processors.process(rows.limit(0), ["ai_runtime"]).count() == 0


def test_entities_are_those_of_single_searches(spark):
    """Each pattern alone, one match after the other; the kind by the first pattern that finds anything in the piece."""
    expected = []
    for row in searching.table(spark, DATA, "documents").select("doc_id", "text").collect():
        spans = {}
        for kind, pattern, confidence in T.ENTITIES:
            at, text = 0, row.text or ""
            while at <= len(text) and (m := re.compile(pattern).search(text, at)):
                spans.setdefault((m.start(), m.end(), kind), []).append(confidence)
                at = max(m.end(), at + 1)
        for (a, b, _), confidences in spans.items():
            piece = row.text[a:b]
            kinds = [k for k, p, _ in T.ENTITIES if re.search(p, piece)]
            expected.append((row.doc_id, piece, kinds[0] if kinds else "UNKNOWN", max(confidences), len(row.text[:a].encode()), len(row.text[:b].encode())))
    found = searching.text_entities(spark, DATA).select("doc_id", "entity", "kind", "confidence", "start", "end").collect()
    assert len(expected) > 20
    assert sorted(map(tuple, found)) == sorted(expected)


def test_resources_of_pages(spark):
    html = """<A class=x href="/a"><img data-src="no" src='i.png'><script src = "s.js"></script><link rel="x"
        href="c.css"><form method="post" action="/f"><iframe src="if"></iframe><frame src="fr"><a href=""><abbr href="z">"""
    hostile = "<a " * 200_000 + "<img" + " " * 200_000
    rows = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, hostile)], "id long, html string")
    began = time.monotonic()
    found = {r.id: r.asDict() for r in rows.select("id", *(c.alias(t) for t, c in pages.resources(F.col("html")).items())).collect()}
    assert time.monotonic() - began < 60
    assert {k: v for k, v in found[1].items() if k != "id"} == {"a": ["/a"], "img": ["i.png"], "script": ["s.js"], "link": ["c.css"], "form": ["/f"], "iframe": ["if"], "frame": ["fr"]}
    assert all(not v for r in (2, 3, 4) for k, v in found[r].items() if k != "id")


def test_an_index_and_its_actions(spark):
    schema = "id long, title string, body string, kind string, source string, ts timestamp, metadata map<string,string>"
    docs = spark.createDataFrame([(1, "red", "", "k", "s", None, {}), (2, "", "red red", "k", "s", None, {}), (3, None, None, None, None, None, None)], schema)
    index = S.Index(docs.limit(0)).index(docs)
    assert index.count().collect()[0][0] == 3
    assert [(r.id, r.score, r.total_count) for r in index.search("red", 1).collect()] == [(1, 3.0, 2)]
    again = index.index(spark.createDataFrame([(1, "blue", "", "k", "s", None, {})], schema))
    assert [(r.id, r.total_count) for r in again.search("red").collect()] == [(2, 1)]
    assert again.count().collect()[0][0] == 3
    assert index.search("green").collect() == [] and index.clear().count().collect()[0][0] == 0


def test_keys_and_files(spark, tmp_path):
    held = spark.createDataFrame([("a", "1")], "key string, value string")
    assert [catalog.kv_exists(held, k).collect()[0][0] for k in ("a", "b")] == [True, False]
    path = f"{tmp_path}/sub/x.bin"
    assert not catalog.path_exists(spark, path)
    assert catalog.write_file(spark, path, b"\x00\xff") == path and catalog.path_exists(spark, path)
    assert bytes(catalog.files(spark, f"{tmp_path}/sub").collect()[0].data) == b"\x00\xff"
    with pytest.raises(Exception, match="exist"):
        catalog.write_file(spark, path, b"", overwrite=False)
