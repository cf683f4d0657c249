"""Token ids in sorted-string-table shards.

A shard holds documents by ascending key in blocks. Layout, little-endian::

    block*      entries; an entry is
                varint shared, varint rest, varint size, key[shared:], value
                (the key shares its first bytes with the entry before; the
                first entry of a block, a restart, shares none)
    index       per block: varint key length, first key, varint offset, varint length
    bloom       u32 bits, u8 probes, bit array over all keys
    footer      u64 index offset, u64 bloom offset, u64 entries, u64 ids, 8-byte magic

Keys are big-endian with the sign bit flipped, so byte order is number order; a
null key is the empty key, which sorts first; a key that repeats gets one entry
a row. A value is the width of an id in bytes and the ids. ``lookup`` asks the Bloom filter, finds
the block by binary search of the sparse index, and reads that one block.

Shards are cut by key ranges that depend on the keys alone. Each is written
under a temporary name that no other attempt uses and renamed when whole, so a
lost executor leaves at most an unreferenced file; the manifest lists the shards
that count.

Defined cases: a null or empty text has only the end id; empty tables give an
empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tessella.llm.pretokens import cutter
from tessella.llm.store import commit, ranged, written

MAGIC = b"TSSTABL1"
BLOCK_BYTES = 1 << 16
BITS_A_KEY = 10
PROBES = 7
_FOOTER = struct.Struct("<QQQQ8s")
_CACHE = 1_000_000  # words whose ids a Python worker keeps

MANIFEST = "shard int, path string, entries long, ids long, bytes long, sha256 string, first long, last long"


# ---------------------------------------------------------------- bytes


def key_bytes(key: int | None) -> bytes:
    return b"" if key is None else struct.pack(">Q", (key + (1 << 63)) & ((1 << 64) - 1))


def key_number(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as 16-bit or, if one needs more, 32-bit little-endian numbers after a byte that holds the width."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return b"\x04" + ids.astype("<u4").tobytes() if wide else b"\x02" + ids.astype("<u2").tobytes()


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if packed[0] == 4 else "<u2", offset=1).astype("<u4", copy=False)


def _probes(key: bytes, bits: int) -> list[int]:
    h = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes one shard to an open binary stream; keys must not fall."""

    def __init__(self, out):
        self.out = out
        self.at = self.entries = self.ids = 0
        self.digest = hashlib.sha256()
        self.block: list[bytes] = []
        self.block_size = 0
        self.first = self.last = b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.digest.update(raw)
        self.at += len(raw)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must not fall")
        value = pack_ids(ids)
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        self.last = key
        self.hashes.append(key)
        self.entries += 1
        self.ids += len(ids)
        if self.block_size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            self.index.append((self.first, self.at, len(raw)))
            self._put(raw)
            self.block, self.block_size = [], 0

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index))
        bloom_at = self.at
        bits = max(64, BITS_A_KEY * len(self.hashes))
        array = bytearray(-(-bits // 8))
        for key in self.hashes:
            for p in _probes(key, bits):
                array[p >> 3] |= 1 << (p & 7)
        self._put(struct.pack("<IB", bits, PROBES) + bytes(array))
        self._put(_FOOTER.pack(index_at, bloom_at, self.entries, self.ids, MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary stream: footer, index and filter first, blocks when asked."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - _FOOTER.size)
        index_at, bloom_at, self.entries, self.ids, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard, or cut short")
        f.seek(index_at)
        raw = f.read(size - _FOOTER.size - index_at)
        self.bits, _ = struct.unpack_from("<IB", raw, bloom_at - index_at)
        self.bloom = raw[bloom_at - index_at + 5:]
        self.keys, self.places, at = [], [], 0
        while at < bloom_at - index_at:
            n, at = _read_varint(raw, at)
            self.keys.append(raw[at:at + n])
            place, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.places.append((place, length))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        place, length = self.places[i]
        self.f.seek(place)
        raw = self.f.read(length)
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at:at + rest]
            at += rest + size
            yield key, raw[at - size:at]

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        if not self.entries or not self.may_hold(key):
            return []
        found = []
        i = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while i < len(self.places) and self.keys[i] <= key:
            found += [unpack_ids(value) for k, value in self.block(i) if k == key]
            i += 1
        return found


# ---------------------------------------------------------------- encoding


class Encoder:
    """Texts to ids by the tokenizers library, each distinct pre-token encoded once while it is remembered.

    ``pattern`` must cut as the tokenizer's byte-level pre-tokenizer does. The
    library is given the pieces cut, many at a time, and its ids are dealt to
    the pieces by the bytes that each id stands for. A text that holds the string
    of an added token, such as <|endoftext|>, is given to the library whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.post_processor = None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)  # a byte is one character here
        self.find = cutter(pattern)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        pieces = [words[i:i + 1000] for i in range(0, len(words), 1000)]
        found = self.tokenizer.encode_batch_fast(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        word_ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        ends = np.searchsorted(np.cumsum(self.widths[ids]), word_ends) + 1
        if len(words) and (ends[-1] != len(ids) or (np.cumsum(self.widths[ids])[ends - 1] != word_ends).any()):
            raise ValueError("the tokenizer's ids do not cover the pieces byte for byte")
        starts = np.concatenate(([0], ends[:-1]))
        self.starts = np.concatenate([self.starts, (starts + len(self.flat)).astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, (ends - starts).astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids])

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > _CACHE:
            self._forget()
        before = len(self.known)
        special = {i: t for i, t in enumerate(texts) if t and self.added(t)}
        codes = [np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)) for words in ([] if i in special else self.find(t or "") for i, t in enumerate(texts))]
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        out = []
        for c in codes:
            n = self.lengths[c]
            ends = np.cumsum(n, dtype=np.int32)
            out.append(self.flat[np.repeat(self.starts[c] - (ends - n), n) + np.arange(ends[-1] if len(c) else 0, dtype=np.int32)])
        for i, t in special.items():
            out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    """A Python worker's encoder, kept from task to task."""
    return Encoder(path, pattern)


# ---------------------------------------------------------------- tables


def write(docs: DataFrame, path: str, tokenizer: str, pattern: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_rows: int = 4096, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write the ids of every document row to shards below ``path``; returns the manifest, one row a shard.

    A key range has about ``shard_rows`` rows, and more where that would make
    over 20,000 ranges; a shard is rolled once it holds
    ``shard_bytes``. Rows of one key are ordered by their text.
    """
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    dealt, _ = ranged(own, "key", shard_rows)
    order = dealt.sortWithinPartitions("key", "text")

    def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        encoder = _encoder(tokenizer, pattern)
        writer = out = temporary = None
        made: list[tuple] = []

        def close(shard: int) -> None:
            writer.close()
            out.close()
            final = f"{root}/shard-{shard:06d}-{len(made):06d}.sst"
            commit(fs, temporary, final)
            made.append((shard, final, writer.entries, writer.ids, writer.at, writer.digest.hexdigest(), key_number(next((k for k in writer.hashes if k), b"")), key_number(writer.last)))

        shard = 0
        for batch in batches:
            keys, shards = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i in range(0, len(keys), 1000):
                for k, s, ids in zip(keys[i:i + 1000], shards[i:i + 1000], encoder(batch.column(1).slice(i, 1000).to_pylist()), strict=True):
                    if writer is None:
                        shard, temporary = s, f"{root}/.writing-{uuid.uuid4().hex}"
                        out = fs.open_output_stream(temporary, compression=None)
                        writer = ShardWriter(out)
                    writer.add(key_bytes(k), np.append(ids, np.uint32(end_id)))
                    if writer.at >= shard_bytes:
                        close(shard)
                        writer = None
        if writer is not None:
            close(shard)
        yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST_ARROW.names, m, strict=True)) for m in made], _MANIFEST_ARROW)

    return written(order.select("key", "text", "range").mapInArrow(write_shards, MANIFEST), "manifest")


def read(manifest: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start, ids): every entry of the manifest's shards in key order; ``ids`` holds little-endian unsigned 32-bit ids, ``start`` counts the ids before them.

    Offsets of ranges, some 20,000 at most, are summed on the driver; those of
    the shards of a range by a window over its manifest rows.
    """
    spark = manifest.sparkSession
    sums, offsets, at = sorted(manifest.groupBy("shard").agg(F.sum("ids"), F.count("*")).collect()), [], 0
    for shard, ids, _ in sums:
        offsets.append((shard, at))
        at += ids
    shards = sum(n for _, _, n in sums)

    def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for place, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(place) as f:
                    shard = ShardReader(f, size)
                    keys, starts, values, held = [], [], [], 0
                    for k, packed in shard:
                        ids = unpack_ids(packed)
                        keys.append(key_number(k))
                        starts.append(start)
                        values.append(ids.astype("<u4").tobytes())
                        start += len(ids)
                        held += len(values[-1])
                        if held > 8 << 20:
                            yield entries(keys, starts, values)
                            keys, starts, values, held = [], [], [], 0
                    yield entries(keys, starts, values)

    def entries(keys: list, starts: list, values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], names=[key, "start", "ids"])

    before = F.coalesce(F.sum("ids").over(Window.partitionBy("shard").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("before", before).join(F.broadcast(spark.createDataFrame(offsets, "shard int, offset long")), "shard")
    listed = placed.select("path", (F.col("offset") + F.col("before")).alias("start"), "bytes")
    return listed.repartitionByRange(max(1, shards), "path").mapInArrow(read_shards, f"`{key}` long, start long, ids binary")


def lookup(manifest: DataFrame, path: str, keys: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, ids): every entry with one of the keys, by binary search in the shards that may hold it.

    A key finds its range, of some 20,000, by their first keys, and the range's
    shards by a join that compares first and last keys; each shard is then asked
    by one task: its filter, its sparse index, and the blocks that may hold the
    key. Null keys are not looked up; a key that no entry has gives no row.
    """
    spark = manifest.sparkSession
    ranges = sorted((r[1], r[0]) for r in manifest.where("first is not null").groupBy("shard").agg(F.min("first")).collect())
    held = spark.sparkContext.broadcast((np.array([f for f, _ in ranges], np.int64), np.array([s for _, s in ranges], np.int32)))
    wanted = keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, shards = held.value
        for batch in batches:
            at = np.searchsorted(firsts, batch.column(0).to_numpy(), side="right") - 1
            inside = batch.filter(pa.array(at >= 0))
            yield pa.RecordBatch.from_arrays([inside.column(0), pa.array(shards[at[at >= 0]], pa.int32())], names=["key", "at"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(path)
        f = shard = opened = None
        for batch in batches:
            found: list[tuple[int, bytes]] = []
            for place, size, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != opened:
                    if f is not None:
                        f.close()
                    f, opened = fs.open_input_file(place), place
                    shard = ShardReader(f, size)
                found += [(k, ids.astype("<u4").tobytes()) for ids in shard.get(key_bytes(k))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], names=[key, "ids"])
        if f is not None:
            f.close()

    placed = wanted.mapInArrow(place, "key long, at int")
    asked = placed.join(manifest, (placed.at == manifest.shard) & (placed.key >= manifest["first"]) & (placed.key <= manifest["last"])).select("path", "bytes", "key")
    return asked.repartition("path").sortWithinPartitions("path", "key").mapInArrow(ask, f"`{key}` long, ids binary")


_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
