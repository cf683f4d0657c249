"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are the maximal runs of bytes outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``
after A-Z are lower-cased, so a word holds digits, a-z and any non-ASCII
character. Every run of ``window`` consecutive words of a benchmark item is a
window; an item with fewer words, but not none, is one window. A document word
inside any occurrence of any window is hit.

A window is held as a 64-bit hash in a sorted array with its item and place,
some 24 bytes for each benchmark word, and every hit is verified on the words
themselves. The array of at most ``block_bytes`` of benchmark text is broadcast;
a larger benchmark is scanned block by block, each pass over all documents, and
the blocks' hits are merged.

Defined cases: a null or empty text has no words, no hits and is clean; null or
wordless items have no windows; equal items are all reported; null item ids are
never reported but their windows count as hits; repeated document rows are
judged row by row; extra columns of either table are ignored by ``scan`` and
kept by ``clean``. Keys and item ids may be of any type; ids that are no whole
numbers are reported as strings. A key column may not be named like one of the
columns that ``scan`` returns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tessella.llm.store import written

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^\x20]+")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

# Hashes are polynomials modulo 2**64 in an odd base, so that sums up to a place give those of any run.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 16
_LONG = 4096  # bytes of a word
_FILTER_BITS = 22


def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _power(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Powers of any size from the table of the first ones."""
    if not len(at) or at[-1] <= _PIECE:  # places rise
        return table[at]
    high = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(int(at[-1]) // _PIECE, table[_PIECE], np.uint64))))
    return table[at % _PIECE] * high[at // _PIECE]


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run [start, end) of values."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _power(_UP, np.arange(len(values))), dtype=np.uint64)))
    return (sums[ends] - sums[starts]) * _power(_DOWN, starts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The normalised words of some bytes: where they are, and hashes of runs of them."""

    def __init__(self, raw: bytes):
        self.raw = raw.translate(_TABLE)
        letters = np.frombuffer(self.raw, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], letters != 0x20, [False]))))
        self.starts, self.ends = edges[::2], edges[1::2]
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def run(self, first: int, n: int) -> bytes:
        """Words first .. first + n - 1, space-joined."""
        return b" ".join(self.raw[self.starts[first]:self.ends[first + n - 1]].split())

    def _hashed(self) -> np.ndarray:
        """The hash of every word, in pieces of bounded size; very long words are hashed one by one."""
        out = np.empty(len(self), np.uint64)
        long = np.flatnonzero(self.ends - self.starts > _LONG)
        bounds = np.unique(np.concatenate((np.arange(0, len(self), _PIECE), long, long + 1, [len(self)]))).astype(np.int64)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at, end = int(self.starts[i]), int(self.ends[j - 1])
            if end - at > _LONG and j == i + 1:
                out[i] = xxhash.xxh64_intdigest(self.raw[at:end])
            else:
                letters = np.frombuffer(self.raw, np.uint8, end - at, at).astype(np.uint64)
                out[i:j] = _mixed(_runs(letters + np.uint64(1), self.starts[i:j] - at, self.ends[i:j] - at))
        return out

    def windows(self, n: int) -> np.ndarray:
        """The hash of every run of n words."""
        if self._hashes is None:
            self._hashes = self._hashed()
        at = np.arange(max(len(self) - n + 1, 0))
        return _mixed(_runs(self._hashes, at, at + n))


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode().translate(_TABLE).split() if text else []


def windows(item: list[bytes], window: int) -> list[bytes]:
    """The distinct windows of an item's words, space-joined."""
    if not item:
        return []
    n = min(window, len(item))
    return list(dict.fromkeys(b" ".join(item[i:i + n]) for i in range(len(item) - n + 1)))


class NGramIndex:
    """The windows of items by hash, in sorted arrays by window length, with a bit table that rules out nearly every other hash."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        raw = [b" ".join(words(text)) for _, text in items]
        self.ids = [i for i, _ in items]
        self.text = Words(b"\n".join(raw))  # items apart by one blank
        counts = np.array([r.count(b" ") + 1 if r else 0 for r in raw], np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(window, int(c)) for c in counts if c}):
            own = np.flatnonzero(counts == n) if n < window else np.flatnonzero(counts >= window)
            many = counts[own] - n + 1
            item = np.repeat(own, many)
            place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[item]
            hashes = self.text.windows(n)[place]
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            filled = np.zeros(1 << _FILTER_BITS, bool)
            filled[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length[n] = hashes, item[order].astype(np.int32), place[order].astype(np.int32), np.packbits(filled, bitorder="little")
        self.text._hashes = None
        self.least = min(self.by_length, default=0)
        self.known: dict[tuple[int, int], dict[bytes, list]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def _windows(self, n: int, found: int) -> dict[bytes, list]:
        """The windows with the hash at a place of the sorted array, and the ids of their items."""
        held = self.known.get((n, found))
        if held is None:
            hashes, item, place, _ = self.by_length[n]
            held = {}
            for k in range(found, int(np.searchsorted(hashes, hashes[found], side="right"))):
                ids = held.setdefault(self.text.run(int(place[k]), n), [])
                own = self.ids[item[k]]
                if own is not None and (not ids or ids[-1] != own):
                    ids.append(own)
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[n, found] = held
        return held

    def hits(self, own: Words) -> tuple[set, list[tuple[int, int]]]:
        """Ids of the items with a window in these words, and the merged word spans that the windows cover."""
        items: set = set()
        found: list[tuple[int, int]] = []
        if not self.least or len(own) < self.least:
            return items, found
        for n, (hashes, _, _, bits) in self.by_length.items():
            seen = own.windows(n)
            cell = seen >> np.uint64(64 - _FILTER_BITS)
            maybe = np.flatnonzero(bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)
            if not len(maybe):
                continue
            at = np.searchsorted(hashes, seen[maybe])
            same = hashes[np.minimum(at, len(hashes) - 1)] == seen[maybe]
            for i, k in zip(maybe[same].tolist(), at[same].tolist(), strict=True):
                ids = self._windows(n, k).get(own.run(i, n))
                if ids is not None:
                    items.update(ids)
                    found.append((i, i + n))
        return items, _merged(found)


def _scan_block(docs: DataFrame, held: Broadcast, key: str, text: str, ids: str) -> DataFrame:
    """(_key, _digest, n_words, items, spans) of each document row against one broadcast block."""

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            counts, items, spans = [], [], []
            for t in batch.column(2):
                own = Words((t.as_py() or "").encode())
                found, covered = index.hits(own)
                counts.append(len(own))
                items.append(sorted(found))
                spans.append([{"start": a, "end": b} for a, b in covered])
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.int64() if ids == "bigint" else pa.string())), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_digest", "n_words", "items", "spans"])

    own = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text).cast("string")).alias("_digest"), F.col(text).cast("string").alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return own.mapInArrow(scan_batches, f"_key {kind}, _digest long, n_words long, items array<{ids}>, spans array<struct<start:int,end:int>>")


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[list[DataFrame], str]:
    """The benchmark as parts of at most about block_bytes of text each, a larger item being a part of its own, and the type of its ids."""
    ids = "bigint" if benchmark.schema[item_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    items = benchmark.select(F.col(item_id).cast(ids).alias("_id"), F.col(text).cast("string").alias("_text")).where("_text is not null")
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if total <= block_bytes:
        return [items], ids
    n = 2 * -(-total // block_bytes)
    return [items.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(n)) == k) for k in range(n)], ids


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_key, n_words, items, spans, more_items, more_spans) to rows with the two sides in one."""
    for batch in batches:
        items, spans = [], []
        for a, b, more_a, more_b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
            items.append(sorted({*a, *(more_a or ())}))
            spans.append([{"start": x, "end": y} for x, y in _merged([(s["start"], s["end"]) for s in (*b, *(more_b or ()))])])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, batch.schema.field(2).type), pa.array(spans, _SPANS)], names=["_key", "n_words", "items", "spans"])


def scan(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document row: key, n_words, n_hit, items (sorted ids), spans (word offsets, end exclusive).

    With one block this is a single map over the documents, without a shuffle.
    With several, each block is a pass of its own whose hits are written to the
    shared folder; only rows that were hit are merged, by key and text digest.
    """
    spark = docs.sparkSession
    parts, ids = _blocks(benchmark, item_id, item_text, block_bytes)
    passes = []
    for part in parts:
        items = [(r[0], r[1]) for r in part.collect()]  # about block_bytes of text at most
        held = spark.sparkContext.broadcast(NGramIndex(items, window))
        passes.append(_scan_block(docs, held, key, text, ids))
        if len(passes) > 1:
            passes[-1] = written(passes[-1].where(F.size("spans") > 0).dropDuplicates(["_key", "_digest"]), "decontam")
            held.unpersist()
    out = passes[0]
    if len(passes) > 1:
        rest = passes[1]
        for more in passes[2:]:
            rest = rest.union(more)
        rest = rest.groupBy(F.col("_key").alias("_other"), F.col("_digest").alias("_same")).agg(F.flatten(F.collect_list("items")).alias("more_items"), F.flatten(F.collect_list("spans")).alias("more_spans"))
        out = out.join(rest, out["_key"].eqNullSafe(rest["_other"]) & out["_digest"].eqNullSafe(rest["_same"]), "left")
        kind = docs.schema[key].dataType.simpleString()
        out = out.select("_key", "n_words", "items", "spans", "more_items", "more_spans").mapInArrow(_merge, f"_key {kind}, n_words long, items array<{ids}>, spans array<struct<start:int,end:int>>")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return out.select(F.col("_key").alias(key), "n_words", hit.alias("n_hit"), "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents without benchmark text, all columns kept.

    ``remove="documents"`` drops every document that was hit; ``"spans"`` cuts
    the hit words out of the text, with what stands between them, and keeps the
    document. A benchmark of several blocks takes a pass for each: documents
    that one pass has dropped are not read by the next; spans are gathered by
    the text's digest over all passes and cut once.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    parts, _ = _blocks(benchmark, item_id, item_text, block_bytes)
    at = docs.columns.index(text)
    if remove == "spans" and len(parts) > 1:
        digest = F.sha2(F.col(text).cast("string"), 256)
        texts = docs.select(digest.alias("_of"), F.col(text).alias("_text"))
        found = scan(texts, benchmark, key="_of", text="_text", item_id=item_id, item_text=item_text, window=window, block_bytes=block_bytes)
        found = written(found.where(F.size("spans") > 0).select("_of", "spans").dropDuplicates(["_of"]).withColumnRenamed("spans", "_spans"), "decontam")
        joined = docs.withColumn("_sha", digest)
        joined = joined.join(found, joined["_sha"] == found["_of"], "left").select(*(docs[c] for c in docs.columns), "_spans")

        def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = batch.column(batch.num_columns - 1).to_pylist()
                values = [without(t, [(s["start"], s["end"]) for s in own]) if own else t for t, own in zip(batch.column(at).to_pylist(), spans, strict=True)]
                out = batch.select(range(batch.num_columns - 1))
                yield out.set_column(at, out.schema.field(at), pa.array(values, out.schema.field(at).type))

        return joined.mapInArrow(cut_out, docs.schema)
    out = docs
    for k, part in enumerate(parts):
        held = docs.sparkSession.sparkContext.broadcast(NGramIndex([(r[0], r[1]) for r in part.collect()], window))  # about block_bytes of text at most
        out = out.mapInArrow(_cut(held, at, remove), docs.schema)
        if k + 1 < len(parts):
            out = written(out, "decontam")
            held.unpersist()
    return out


def _cut(held: Broadcast, at: int, remove: str):
    """Rows without the documents, or the spans, that one block hits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            kept, texts = [], []
            for i, t in enumerate(batch.column(at)):
                value = t.as_py()
                _, spans = index.hits(Words((value or "").encode()))
                if spans and remove == "documents":
                    continue
                kept.append(i)
                texts.append(without(value, spans) if spans else value)
            out = batch.take(pa.array(kept, pa.int64()))
            yield out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))

    return cut


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of these spans and the bytes between the words of one span."""
    raw = text.encode()
    found = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:found[a][0]])
        at = found[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """What ``scan`` found, with the items as a digest: the ids sorted as strings and comma-joined, in SHA-256."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return scanned.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
