"""Deterministic sharded WARC archives.

Records are dealt to shards by key ranges that depend on the keys alone and
sorted within them; a shard's file is rolled once its compressed size passes a
limit. All headers are made anew from the record itself: ids are derived from
key, type and payload, dates come from the caller, digests from the bytes. Each
record is a gzip member of its own with no time stamp, so the same table gives
the same bytes. A task writes below temporary names of its own, gives a file its
name once it is whole, and returns manifest rows; the manifest, itself a table
committed by Spark, lists the files that count.

Of records with equal payloads of at least ``least_revisit`` bytes, the one with
the smallest key is a response and the others are revisits, which hold the HTTP
header and no payload.

Defined cases: a null payload is empty; a null url is written as an empty
``urn:`` target and read back as null; of equal rows with the smallest key all
are responses; null keys sort first and never stand for a payload; an empty
table has an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from tessella.llm.store import commit, ranged, written

MANIFEST = "shard int, path string, records long, bytes long, sha256 string"
_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
RECORDS = "record_id string, key long, url string, record_type string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_NAMESPACE = uuid.UUID("9d2c1c04-3f0e-5d54-8a57-6f1d2b6a7c11")
_NO_URL = "urn:none"


def record_id(key: int | None, kind: str, digest: str) -> str:
    """A record's id, derived from what it records."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key} {kind} {digest}')}>"


def _member(raw: bytes, level: int) -> bytes:
    """One gzip member without name or time."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _text(headers: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in headers).encode()


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of a response record, or of a revisit if refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\n" + _text([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key, kind, digest)), ("WARC-Date", date), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else _NO_URL)]
    if key is not None:
        headers.append(("X-Key", str(key)))
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, "response", digest)), ("X-Refers-To-Key", str(refers_to))]
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _text(headers) + b"\r\n" + block + b"\r\n\r\n"


def _info(shard: int, part: int, date: str) -> bytes:
    body = _text([("software", "tessella"), ("format", "WARC File Format 1.1"), ("isPartOf", f"{shard:06d}-{part:03d}")])
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(shard, "warcinfo", str(part))), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + _text(headers) + b"\r\n" + body + b"\r\n\r\n"


def _records(pages: DataFrame, key: str, url: str, payload: str, least_revisit: int) -> DataFrame:
    """Rows (key, of, url, payload, digest, refers_to) to write: a page's own row, after slim rows that say which payload of that key is a revisit.

    Payloads are not shuffled to find equal ones, only their digests are. Both
    sides of that join are plain tables, so adaptive execution can split a
    digest that a third of all rows share.
    """
    own = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = written(own.where((F.octet_length("payload") >= least_revisit) & F.col("key").isNotNull()).select("key", "digest"), "warc")
    first = written(slim.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first"), "warc")
    again = written(slim.join(first, slim.digest == first.same).where("key <> first").select("key", "digest", "first").distinct(), "warc")
    marks = again.select("key", F.lit(0).alias("of"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.col("first").alias("refers_to"))
    return marks.union(own.select("key", F.lit(1).alias("of"), "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to")))


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2020-01-01T00:00:00Z", least_revisit: int = 100, shard_rows: int = 4096, roll_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write a record for every row below ``path``; returns the manifest, one row a file.

    A key range has about ``shard_rows`` rows, and more where that would make
    over 20,000 ranges; files are rolled at ``roll_bytes`` either way.
    """
    dealt, _ = ranged(_records(pages, key, url, payload, least_revisit), "key", shard_rows)
    order = dealt.sortWithinPartitions("key", "of", "digest", "url")

    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        made: list[dict] = []
        out = temporary = digest = None
        size = records = 0

        def put(raw: bytes) -> None:
            nonlocal size
            packed = _member(raw, level)
            out.write(packed)
            digest.update(packed)
            size += len(packed)

        def close() -> None:
            out.close()
            final = f"{root}/part-{shard:06d}-{len(made):06d}.warc.gz"
            commit(fs, temporary, final)
            made.append({"shard": shard, "path": final, "records": records, "bytes": size, "sha256": digest.hexdigest()})

        shard, last, revisits = 0, None, {}
        for batch in batches:
            for own, of, target, body, hexed, first, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != last:
                    last, revisits = own, {}
                if not of:
                    revisits[hexed] = first
                    continue
                if out is None:
                    shard, temporary, digest, size, records = place, f"{root}/.writing-{uuid.uuid4().hex}", hashlib.sha256(), 0, 0
                    out = fs.open_output_stream(temporary, compression=None)
                    put(_info(shard, len(made), date))
                put(record(own, target, body, hexed, revisits.get(hexed), date))
                records += 1
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, _MANIFEST_ARROW)

    columns = order.select("key", "of", "url", "payload", "digest", "refers_to", "range")
    return written(columns.mapInArrow(write_files, MANIFEST), "manifest")


def members(f) -> Iterator[bytes]:
    """The gzip members of a binary stream, each inflated."""
    squeeze, parts, rest = zlib.decompressobj(31), [], b""
    while raw := rest or f.read(1 << 16):
        parts.append(squeeze.decompress(raw))
        rest = squeeze.unused_data
        if squeeze.eof:
            yield b"".join(parts)
            squeeze, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a record; the block's digest is verified if it is stated."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(headers["Content-Length"])]
    stated = headers.get("WARC-Block-Digest")
    if stated and stated != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"the block of {headers.get('WARC-Record-ID')} does not match its digest")
    return headers, block


def read(manifest: DataFrame, path: str, *, payloads: bool = True) -> DataFrame:
    """The response and revisit records of a manifest's archives; the payload of a revisit is null, and of all records unless asked for."""

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for place in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(place, compression=None) as f:
                    for raw in members(f):
                        headers, block = parse(raw)
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        rows.append(_row(headers, block, payloads))
                        size += len(raw)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _RECORDS_ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _RECORDS_ARROW)

    paths = manifest.select("path")
    return paths.repartitionByRange(max(1, manifest.count()), "path").mapInArrow(read_files, RECORDS)


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["WARC-Type"] == "revisit"
    stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != stated:
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not match its digest")
    length = next(int(line.split(b": ", 1)[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: "))
    url = headers["WARC-Target-URI"]
    return {
        "record_id": headers["WARC-Record-ID"], "key": int(headers["X-Key"]) if "X-Key" in headers else None, "url": None if url == _NO_URL else url, "record_type": headers["WARC-Type"], "date": headers["WARC-Date"],
        "payload_bytes": length, "payload_digest": stated, "refers_to": int(headers["X-Refers-To-Key"]) if revisit else None, "payload": payload if payloads and not revisit else None,
    }


_RECORDS_ARROW = pa.schema([
    ("record_id", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("date", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
