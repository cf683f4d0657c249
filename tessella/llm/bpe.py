"""Byte-level BPE over a corpus by a global shuffle of distinct words.

Encoding. Documents are cut into pre-tokens; a block of consecutive documents
(about ``block_bytes`` of text) keeps each distinct word once, and each document
becomes the sequence of its words' numbers in the block: the exploded positions,
held as a packed array instead of one row a position. The words are shuffled by
their hash, each distinct word is encoded once, the ids go back to the blocks,
and every document is put together again by position. A word costs a block one
entry however often it occurs, so a word that makes up a third of the corpus
costs no more than any other.

Decoding joins the table of token bytes. Its size is that of the vocabulary
file, so it is broadcast.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated
rows and keys are encoded row by row; null keys are kept; only the named columns
are read, so others may clash.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.pretokens import cutter
from tessella.llm.store import written
from tessella.llm.workers import release

_WORDS, _DOCUMENTS = 0, 1
_SHORT = (1 << 14) + (1 << 7)  # numbers that pack to one or two bytes, about
_ROW_WORDS = 1 << 18  # words of the documents in one packed row, about


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a vocabulary file: a line holds base64 bytes and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _word_encoder(path: str) -> tiktoken.Encoding:
    """Merges a whole string as one piece: pre-tokens are cut beforehand."""
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    by_rank = {rank: token for token, rank in load_ranks(path).items()}
    return [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]


def _pack(codes: np.ndarray) -> bytes:
    """Numbers as little-endian groups of 7 bits, the high bit set in all but the last byte."""
    if not len(codes):
        return b""
    groups = 1 + (codes >= 1 << 7) + (codes >= 1 << 14) + (codes >= 1 << 21) + (codes >= 1 << 28)
    ends = np.cumsum(groups)
    out = np.empty(ends[-1], np.uint8)
    starts = ends - groups
    for k in range(int(groups.max())):
        has = groups > k
        out[starts[has] + k] = ((codes[has] >> (7 * k)) & 0x7F) | np.where(groups[has] > k + 1, 0x80, 0)
    return out.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = raw < 0x80
    ends = np.flatnonzero(last)
    starts = np.empty(len(ends), np.int64)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max()) + 1):
        has = starts + k <= ends
        out[has] |= (raw[starts[has] + k].astype(np.int64) & 0x7F) << (7 * k)
    return out


def _squeeze(raw: bytes) -> bytes:
    return zstandard.compress(raw, 9)


#: Packed rows. Words of a block (kind 0): part is their bucket, sizes their ascending numbers as differences, then their byte lengths.
#: Documents of a block (kind 1): part counts these rows, keys has the documents, sizes their numbers of words, data their words' numbers.
_ROW = "block long, kind byte, part int, keys array<{key}>, n int, sizes binary, data binary"


def _rows(key: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int8(), pa.int32(), pa.list_(key), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "kind", "part", "keys", "n", "sizes", "data"])


def _cut(docs: DataFrame, pattern: str, block_bytes: int, buckets: int) -> DataFrame:
    """A block's distinct words, dealt to buckets by their hash, and its documents as numbers of these words.

    The commonest words have the smallest numbers, which take one or two bytes;
    the others are numbered in the words' order, which packs best.
    """

    def flush(block: int, kind: pa.DataType, held: list[tuple], numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(np.concatenate([codes for _, codes in held]), minlength=len(numbers))
        order = np.argsort(-counts, kind="stable")
        words = list(numbers)
        order[_SHORT:] = sorted(order[_SHORT:].tolist(), key=words.__getitem__)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        dealt: list[tuple[list[int], list[bytes]]] = [([], []) for _ in range(min(buckets, len(words)))]
        at: dict[int, int] = {}
        for code, i in enumerate(order.tolist()):
            word = words[i].encode()
            bucket = crc32(word) % buckets
            codes, own = dealt[at.setdefault(bucket, len(at))]
            codes.append(code)
            own.append(word)
        rows, size = [], 0
        for bucket, k in at.items():
            codes, own = dealt[k]
            sizes = np.concatenate([np.diff(codes, prepend=0), np.fromiter(map(len, own), np.int64, len(own))])
            rows.append((block, _WORDS, bucket, None, len(codes), _squeeze(_pack(sizes)), _squeeze(b"".join(own))))
            if len(rows) == 256:
                yield _rows(kind, rows)
                rows = []
        if rows:
            yield _rows(kind, rows)
        first, part = 0, 0
        for i in range(len(held)):
            size += len(held[i][1])
            if size < _ROW_WORDS and i + 1 < len(held):
                continue
            own = held[first:i + 1]
            packed = _squeeze(_pack(rank[np.concatenate([codes for _, codes in own])]))
            yield _rows(kind, [(block, _DOCUMENTS, part, [k for k, _ in own], len(own), _squeeze(_pack(np.array([len(codes) for _, codes in own]))), packed)])
            first, part, size = i + 1, part + 1, 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = cutter(pattern)
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 24
        held: list[tuple] = []
        numbers = defaultdict(count().__next__)
        size, kind = 0, pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = text.as_py() or ""
                words = find(value)
                held.append((key, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                size += len(value)
                if size >= block_bytes:
                    yield from flush(block, kind, held, numbers)
                    block, size, held, numbers = block + 1, 0, [], defaultdict(count().__next__)
                    release()
        if held:
            yield from flush(block, kind, held, numbers)
        del held, numbers
        release()

    return docs.mapInArrow(cut, _ROW.format(key=docs.schema[0].dataType.simpleString()))


def _encode_words(words: DataFrame, path: str, key: str) -> DataFrame:
    """Packed word rows, a bucket's together, to the same with ids for words: each distinct word of a bucket is merged once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _word_encoder(path).encode_ordinary
        last, known = None, {}
        for batch in batches:
            for block, part, n, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "n", "sizes", "data")), strict=True):
                if part != last:
                    last, known = part, {}
                numbers = _unpack(zstandard.decompress(sizes))
                raw = zstandard.decompress(data)
                ends = np.cumsum(numbers[n:]).tolist()
                out = []
                for a, b in zip([0, *ends], ends, strict=False):
                    word = raw[a:b]
                    if (ids := known.get(word)) is None:
                        ids = known[word] = merge(word.decode())
                    out.append(ids)
                counts = np.fromiter(map(len, out), np.int64, n)
                flat = np.fromiter(chain.from_iterable(out), np.int64, int(counts.sum()))
                yield _rows(own, [(block, _WORDS, part, None, n, _squeeze(_pack(np.concatenate([numbers[:n], counts]))), _squeeze(_pack(flat)))])

    own = to_arrow_type(words.schema["keys"].dataType.elementType)
    return words.repartition("part").sortWithinPartitions("part").mapInArrow(encode, _ROW.format(key=key))


def _reassemble(rows: DataFrame, key: str, partitions: int, tokens: Broadcast | None) -> DataFrame:
    """Packed rows, a block's words first, to (key, ids), and decoded if the token table is given."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, flat, starts, lengths = None, [], None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                own, kind, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(4)[i].as_py()
                sizes, data = (_unpack(zstandard.decompress(batch.column(c)[i].as_py())) for c in (5, 6))
                if own != block:
                    block, parts, flat, starts, lengths = own, [], np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
                if kind == _WORDS:
                    parts.append((np.cumsum(sizes[:n]), sizes[n:], data.astype(np.int32)))
                    continue
                if parts:
                    codes = np.concatenate([p[0] for p in parts])
                    counts = np.concatenate([p[1] for p in parts])
                    flat = np.concatenate([p[2] for p in parts])
                    lengths = np.zeros(int(codes.max()) + 1, np.int64)
                    starts = np.zeros(len(lengths), np.int64)
                    lengths[codes] = counts
                    starts[codes] = np.cumsum(counts) - counts
                    parts = []
                each = lengths[data]
                ends = np.cumsum(each)
                total = int(ends[-1]) if len(ends) else 0
                values = flat[np.repeat(starts[data] - (ends - each), each) + np.arange(total)]
                word_ends = np.cumsum(sizes)
                id_ends = np.concatenate(([0], ends))[np.concatenate(([0], word_ends))]
                keys = batch.column(3)[i].values
                for a in range(0, n, 256):
                    b = min(a + 256, n)
                    ids = pa.ListArray.from_arrays(pa.array(id_ends[a:b + 1] - id_ends[a], pa.int32()), pa.array(values[id_ends[a]:id_ends[b]], pa.int32()))
                    columns = {key: keys.slice(a, b - a), "ids": ids}
                    if tokens is not None:
                        columns["decoded"] = _join_tokens(ids, tokens.value)
                    yield pa.RecordBatch.from_pydict(columns)
        parts = flat = starts = lengths = None
        release()

    kind = rows.schema["keys"].dataType.elementType.simpleString()
    place = F.pmod(F.shiftright("block", 24) + F.col("block").bitwiseAND(F.lit(0xFFFFFF).cast("long")), F.lit(partitions)).cast("int")
    dealt = rows.repartitionById(partitions, place).sortWithinPartitions("block", "kind", "part")
    return dealt.mapInArrow(join, f"`{key}` {kind}, ids array<int>" + ", decoded binary" * (tokens is not None))


def encode(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", block_bytes: int = 32 << 20, decoded: bool = False) -> DataFrame:
    """(key, ids array<int>) of every document row: the ids of its whole text, each match of ``pattern`` merged separately by the ranks at ``path``.

    With ``decoded`` the ids are decoded again, in the same pass, as ``decode`` would.

    Every executor must see ``path``. A block lies within one input partition;
    one Python worker holds its words and ids, so ``block_bytes`` of text bounds
    its memory; a longer text is a block of its own. There are as many buckets
    of words as twice the input's partitions, so a bucket is as bounded.
    """
    own = docs.select(F.col(key), F.col(text).cast("string"))
    partitions = max(1, own.rdd.getNumPartitions())
    kind = own.schema[0].dataType.simpleString()
    cut = written(_cut(own, pattern, block_bytes, 2 * partitions), "bpe")
    ids = _encode_words(cut.where(F.col("kind") == _WORDS), path, kind)
    tokens = docs.sparkSession.sparkContext.broadcast(_token_bytes(path)) if decoded else None
    return _reassemble(ids.unionByName(cut.where(F.col("kind") == _DOCUMENTS)), key, partitions, tokens)


def _join_tokens(ids: pa.Array, table: list[bytes]) -> pa.Array:
    """The bytes of each list of ids. The token table has as many entries as the vocabulary file has lines."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
    out, at = [], 0
    for n in ids.value_lengths().to_pylist():
        out.append(b"".join(map(table.__getitem__, flat[at:at + (n or 0)])))
        at += n or 0
    return pa.array(out, pa.binary())


def decode(df: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of each row's ids, joined from the token table at ``path``; a column of that name is replaced. An id without bytes fails the query."""
    df = df.drop("decoded")
    at = df.columns.index(ids)
    held = df.sparkSession.sparkContext.broadcast(_token_bytes(path))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("decoded", _join_tokens(batch.column(at), held.value))

    return df.mapInArrow(join, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", decoded binary")
