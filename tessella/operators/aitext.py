"""Text analysis: entities, summaries, word vectors."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions import text as T


_PATTERNS = [(kind, re.compile(p), c) for kind, p, c in T.ENTITIES]


def find_entities(text: str) -> Iterator[tuple[str, str, float, int, int]]:
    """(text, kind, confidence, start, end) of matches of all patterns, in bytes; the kind is that of the first pattern that finds anything in the match."""
    seen: dict[tuple[int, int, str], float] = {}
    for kind, pattern, confidence in _PATTERNS:
        for m in pattern.finditer(text):
            at = (*m.span(), kind)
            seen[at] = max(seen.get(at, 0.0), confidence)
    for (a, b, _), confidence in sorted(seen.items()):
        piece = text[a:b]
        start = len(text[:a].encode())
        yield piece, next((n for n, p, _ in _PATTERNS if p.search(piece)), "UNKNOWN"), confidence, start, start + len(piece.encode())


def entities(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity, kind, confidence, start, end) by ``find_entities``; null and empty texts have none, repeated rows give theirs again."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(k, *e) for e in find_entities(t or "")]
            types = (batch.column(0).type, pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "entity", "kind", "confidence", "start", "end"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string")).mapInArrow(find, f"`{key}` {kind}, entity string, kind string, confidence double, start int, end int")


def sentence_scores(rows: DataFrame, key: str, text: str, least_bytes: int = 20) -> DataFrame:
    """(key, position, sentence, score): the text's own sentence counts of a sentence's distinct words, by all its words, with up to half as much again for early ones."""
    each = rows.select(key, F.posexplode(T.sentences(F.col(text))).alias("position", "sentence"))
    total = each.groupBy(key).agg(F.count("*").alias("n_sentences"))
    words = F.filter(F.transform(F.filter(T.white_words(F.lower("sentence")), lambda w: F.octet_length(w) > 2), T.trimmed), lambda w: w != "")
    each = each.withColumn("words", words)
    distinct = each.select(key, "position", F.explode(F.array_distinct("words")).alias("word"))
    frequency = distinct.groupBy(key, "word").agg(F.count("*").alias("f"))
    sums = distinct.join(frequency, [key, "word"]).groupBy(key, "position").agg(F.sum("f").alias("s"))
    joined = each.join(total, key).join(sums, [key, "position"], "left").where(F.octet_length("sentence") >= least_bytes)
    base = F.when(F.size("words") > 0, F.coalesce("s", F.lit(0)) / F.size("words")).otherwise(0.0)
    return joined.select(key, "position", "sentence", (base * (1 + (1 - F.col("position") / F.col("n_sentences")) * 0.5)).alias("score"))


_SENTENCE = re.compile(r"[^.!?]*[.!?]|[^.!?]+$")
_WHITE = " \t\n\r\f\x0b"
_WORD = re.compile(r"[^ \t\n\r\f\x0b]+")


def best_sentences(text: str, most: int = 5, least_bytes: int = 20) -> list[str]:
    """The best sentences of a text in their order, by the rule of ``sentence_scores``."""
    found = [s for s in (x.strip(_WHITE) for x in _SENTENCE.findall(text)) if len(s.encode()) > 1]
    words = [[w for w in (x.strip(string.punctuation) for x in _WORD.findall(s.lower()) if len(x.encode()) > 2) if w] for s in found]
    frequency = Counter(w for own in words for w in set(own))
    scored = []
    for i, (sentence, own) in enumerate(zip(found, words, strict=True)):
        if len(sentence.encode()) >= least_bytes:
            base = sum(frequency[w] for w in set(own)) / len(own) if own else 0.0
            scored.append((-(base * (1 + (1 - i / len(found)) * 0.5)), i))
    return [found[i] for i in sorted(i for _, i in sorted(scored)[:most])]


def summaries(rows: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """(key, summary, n_sentences): the best sentences in their order, joined by spaces; texts without any are left out.

    A summary depends on its text alone, so this is one pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, own) for k, t in zip(batch.column(0), batch.column(1), strict=True) if (own := best_sentences(t.as_py() or "", most))]
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k, _ in found], batch.column(0).type), pa.array([" ".join(own) for _, own in found], pa.string()), pa.array([len(own) for _, own in found], pa.int32())], names=[key, "summary", "n_sentences"])

    return rows.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, summary string, n_sentences int")


def bag_of_words(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, tf): counts by the text's largest count."""
    counts = rows.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    largest = counts.groupBy(key).agg(F.max("n").alias("largest"))
    return counts.join(largest, key).select(key, "term", (F.col("n") / F.col("largest")).alias("tf"))


_QUERIES, _VECTORS = 512, 2048  # queries and vectors of a tile, compared at once
_PAIRS = 1 << 16  # pairs scored at once
_NUMBERS = 1 << 22  # components of a block of queries
_KEPT = 1 << 22  # vectors kept for a block of queries
_LAST = np.iinfo(np.int64).max  # a null id
_NULL, _NAN = -2.0, 2.0  # scores outside of those of cosines, where these rank


def nearest(vectors: DataFrame, queries: DataFrame, k: int, rows_at_once: int = 100_000) -> DataFrame:
    """(query_id, id, score, rank): the k vectors with the largest cosine to each query, exactly; ties go by id.

    Queries are broadcast in blocks of about rows_at_once at most. A task holds tiles of
    a block against tiles of its vectors and keeps k vectors for each query of the
    block, so its memory grows with neither table. A product of matrices leaves
    few pairs of a tile; these are scored one component after the other and
    rounded to 12 digits, so equal vectors have equal scores wherever they stand.

    Defined cases: a vector without length has the cosine 0; a null vector, an
    empty one and one with a null component have the score null, ranked last; one
    with a NaN or infinite component has the score NaN, ranked first.
    """
    spark = queries.sparkSession
    schema = "query_id long, id long, score double"
    asked, others = (df.select(F.col("id").cast("long").alias("id"), "embedding") for df in (queries, vectors))
    parts = -(-asked.count() // max(1, min(rows_at_once, _KEPT // k))) if k > 0 else 0
    found = None
    if parts:
        rows = asked.repartition(parts).mapInArrow(_packed, "width int, ids binary, there binary, numbers binary").toLocalIterator()
        for block in _blocks(rows, rows_at_once):
            one = others.mapInArrow(_best(spark.sparkContext.broadcast(block), k), schema)
            found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which rows have a vector, and the vectors as rows, of doubles."""
    ids = pc.fill_null(batch.column(0), _LAST).to_numpy()
    column = batch.column(1)
    flat = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    widths = np.unique(sizes[sizes > 0])
    if len(widths) > 1:
        raise ValueError(f"vectors of {widths[0]} and of {widths[-1]} components")
    out = np.zeros((len(ids), widths[0] if len(widths) else 0))
    out[sizes > 0] = flat.to_numpy(zero_copy_only=False).reshape(-1, out.shape[1]) if len(widths) else 0
    there = sizes > 0
    if flat.null_count:
        there[np.repeat(np.arange(len(ids)), sizes)[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = False
    out[~there] = 0
    return ids, there, out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many queries each, as bytes."""
    for whole in batches:
        for at in range(0, whole.num_rows, _VECTORS):
            ids, there, numbers = _read(whole.slice(at, _VECTORS))
            yield pa.RecordBatch.from_arrays([pa.array([numbers.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, there, numbers))], names=["width", "ids", "there", "numbers"])


def _blocks(rows: Iterator, rows_at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Packed queries in blocks (ids, which have a vector, vectors)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        widths = sorted({x.shape[1] for _, _, x in held} - {0})
        if len(widths) > 1:
            raise ValueError(f"vectors of {widths[0]} and of {widths[-1]} components")
        width = widths[0] if widths else 0
        return np.concatenate([i for i, _, _ in held]), np.concatenate([t for _, t, _ in held]), np.concatenate([x if x.shape[1] else np.zeros((len(x), width)) for _, _, x in held])

    for row in rows:
        ids = np.frombuffer(row.ids, np.int64)
        one = ids, np.frombuffer(row.there, bool), np.frombuffer(row.numbers).reshape(len(ids), row.width)
        n = len(ids) + sum(len(i) for i, _, _ in held)
        if held and (n > rows_at_once or n * row.width > _NUMBERS):
            yield block()
            held.clear()
        held.append(one)
    if held:
        yield block()


def _without_copies(ids: np.ndarray, there: np.ndarray, numbers: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors without those that have k copies of smaller ids; as copies tie, these are among no query's best."""
    total = numbers.sum(axis=1)
    order = np.lexsort((ids, there, total))
    same = (total[order[1:]] == total[order[:-1]]) & (there[order[1:]] == there[order[:-1]])
    at = np.flatnonzero(same)
    same[at] = (numbers[order[at + 1]] == numbers[order[at]]).all(axis=1)
    place = np.arange(len(order))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), place, 0))
    return order[place - first < k]


class _Vectors:
    """Vectors with their ids and lengths; of those that have no cosine the unit vector is 0."""

    def __init__(self, ids: np.ndarray, there: np.ndarray, numbers: np.ndarray):
        self.ids, self.there, self.columns = ids, there, np.ascontiguousarray(numbers.T)
        self.squares = np.zeros(len(ids))
        with np.errstate(all="ignore"):
            for x in self.columns:
                self.squares += x * x
            self.odd = there & ~np.isfinite(self.squares)
            sized = (self.squares > 0) & ~self.odd
            self.unit = np.divide(numbers, np.sqrt(self.squares)[:, None], out=np.zeros_like(numbers), where=sized[:, None])

    def scores(self, row: np.ndarray, other: _Vectors, col: np.ndarray) -> np.ndarray:
        """Cosines of pairs, to 12 digits; products are summed from the first component to the last."""
        total = np.zeros(len(row))
        for x, y in zip(self.columns, other.columns, strict=True):
            total += x[row] * y[col]
        scale = np.sqrt(self.squares[row] * other.squares[col])
        cosine = np.clip(np.divide(total, scale, out=np.zeros(len(row)), where=scale > 0), -1, 1)
        return np.copysign(np.floor(np.abs(cosine) * 1e12 + 0.5) / 1e12, cosine) + 0.0


def _improve(asked: _Vectors, low: int, others: _Vectors, scores: np.ndarray, found: np.ndarray) -> None:
    """Puts into scores and found, the best so far of each query from low on, what is better in a tile."""
    k, part = scores.shape[1], slice(low, low + _QUERIES)
    near = asked.unit[part] @ others.unit.T
    near[:, others.odd] = _NAN
    near[asked.odd[part]] = _NAN
    near[:, ~others.there] = _NULL
    near[~asked.there[part]] = _NULL
    slack = 1e-15 * (asked.unit.shape[1] + 8)  # of the product; rounding moves scores by half of 1e-12
    least, last = scores[part, -1], found[part, -1]
    floor = least
    if k < near.shape[1] and (least == -np.inf).any():
        floor = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - slack - 0.5e-12)
    row, col = np.nonzero(near >= (floor - slack - 0.5e-12)[:, None])
    value = near[row, col]
    better = (value > least[row] - slack + 0.5e-12) | (others.ids[col] < last[row])
    row, col, value = row[better], col[better], value[better]
    if not len(row):
        return
    for at in range(0, len(row), _PAIRS):
        own = at + np.flatnonzero(np.abs(value[at : at + _PAIRS]) < 1.5)
        value[own] = asked.scores(low + row[own], others, col[own])
    rows = np.unique(row)
    every = np.concatenate([row, np.repeat(rows, k)])
    value = np.concatenate([value, scores[low + rows].reshape(-1)])
    ids = np.concatenate([others.ids[col], found[low + rows].reshape(-1)])
    order = np.lexsort((ids, -value, every))
    first = order[np.searchsorted(every[order], rows)[:, None] + np.arange(k)]
    scores[low + rows], found[low + rows] = value[first], ids[first]


def _best(held: Broadcast, k: int):
    """Rows (id, embedding) to (query_id, id, score), the k best of a task for each query of a block."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Vectors(*held.value)
        scores, found = np.full((len(asked.ids), k), -np.inf), np.full((len(asked.ids), k), _LAST)
        for whole in batches:
            for at in range(0, whole.num_rows, _VECTORS):
                ids, there, numbers = _read(whole.slice(at, _VECTORS))
                widths = numbers.shape[1], asked.unit.shape[1]
                if 0 in widths:
                    numbers = np.zeros((len(ids), widths[1]))
                elif widths[0] != widths[1]:
                    raise ValueError(f"vectors of {widths[0]} and of {widths[1]} components")
                few = _without_copies(ids, there, numbers, k)
                others = _Vectors(ids[few], there[few], numbers[few])
                for low in range(0, len(asked.ids), _QUERIES):
                    _improve(asked, low, others, scores, found)
        at, scores, found = np.flatnonzero(scores > -np.inf), scores.reshape(-1), found.reshape(-1)
        for low in range(0, len(at), _PAIRS):
            own = at[low : low + _PAIRS]
            query, ids, value = asked.ids[own // k], found[own], scores[own]
            yield pa.RecordBatch.from_arrays([pa.array(query, mask=query == _LAST), pa.array(ids, mask=ids == _LAST), pa.array(np.where(value == _NAN, np.nan, value), mask=value == _NULL)], names=["query_id", "id", "score"])

    return best
