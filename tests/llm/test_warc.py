"""WARC archives: round trips, revisits, determinism, and what a lost writer leaves."""

from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from tessella.llm import warc
from tessella.llm.store import fresh_path

LONG = "<p>" + "same page " * 30 + "</p>"
PAGES = [(3, "http://a/3", LONG), (1, "http://a/1", LONG), (2, None, "short"), (4, "http://a/4", "short"), (5, "http://a/5", None), (6, "http://é/ü\n6", "<p>été\r\n\r\n€</p>" * 40), (7, "http://a/7", ""), (9, "http://a/9", "x" * 100), (8, "http://a/8", "x" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99)]


@pytest.fixture(scope="module")
def make_pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], "page_id long, url string, html string, key int, digest string, range int")

    return make


def _archive(spark, pages, **options):
    path = fresh_path(spark, "test")
    manifest = warc.write(pages, path, **options)
    return manifest, warc.read(manifest, path).collect()


@pytest.mark.parametrize("options", [{}, {"shard_rows": 2, "roll_bytes": 300}])
def test_records_come_back_with_revisits(spark, make_pages, options):
    manifest, found = _archive(spark, make_pages(PAGES).repartition(3), **options)
    assert sorted(r.key for r in found) == sorted(p[0] for p in PAGES)
    first = {}
    for key, _, html in sorted(PAGES):
        first.setdefault(html or "", key)
    for r in found:
        _, url, html = next(p for p in PAGES if p[0] == r.key)
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and first[html] != r.key
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None)
        assert r.payload is None if revisit else bytes(r.payload) == raw
        assert r.url == (url.replace("\n", "%0A") if url else None)
    assert sum(m.records for m in manifest.collect()) == len(PAGES)


def test_files_are_the_same_however_the_input_is_split(spark, make_pages):
    digests = [sorted(m.sha256 for m in _archive(spark, make_pages(PAGES).repartition(n), shard_rows=3)[0].collect()) for n in (1, 4)]
    assert digests[0] == digests[1]


def test_files_are_gzip_members_of_whole_records(spark, make_pages):
    manifest, _ = _archive(spark, make_pages(PAGES))
    for m in manifest.collect():
        raw = open(m.path, "rb").read()
        assert len(raw) == m.bytes and hashlib.sha256(raw).hexdigest() == m.sha256
        records = list(warc.members(io.BytesIO(raw)))
        assert b"".join(records) == gzip.decompress(raw)
        assert len(records) == m.records + 1
        ids = [warc.parse(r)[0]["WARC-Record-ID"] for r in records]
        assert len(set(ids)) == len(ids)


def test_damaged_records_are_refused():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2020-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"payload\r\n", b"paYload\r\n"))
    packed = warc._member(raw, 6)
    with pytest.raises(ValueError, match="ends"):
        list(warc.members(io.BytesIO(packed[:-9])))


def test_repeated_and_null_keys_and_empty_tables(spark, make_pages):
    rows = [(None, "u", LONG), (4, "a", LONG), (4, "b", LONG), (5, "c", LONG)]
    _, found = _archive(spark, make_pages(rows))
    assert sorted(((r.key, r.record_type, r.refers_to) for r in found), key=str) == sorted([(None, "response", None), (4, "response", None), (4, "response", None), (5, "revisit", 4)], key=str)
    manifest, found = _archive(spark, make_pages([]))
    assert (manifest.count(), found) == (0, [])
