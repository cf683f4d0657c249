"""SimHash near-duplicates by a self-join of binary tries.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z are
lower-cased; shingles are runs of consecutive words, space-joined, repeats
included (a text with fewer words is one shingle). A fingerprint bit is 1 if it
is set in over half of the shingles' XXH64. Two fingerprints link if at most
``budget`` of their 64 bits differ.

Two linked fingerprints agree in all bits of at least ``parts - budget`` of any
``parts`` parts of the 64 bits. So for each choice of that many parts there is a
forest of tries, one for each value of the chosen bits, and every link lies
inside one tree of one forest. A tree joins with itself: node pairs are
traversed together from (root, root), each step down adds the bits in which the
two children differ, and a pair beyond the budget is pruned with all below it.

What leaves a tree is not its links but a chain through each of its connected
sets, so a group of n near copies yields n - 1 rows and not n * n. Chains of all
trees are joined by large-star and small-star steps, which move nodes only.
A tree with more than ``tree_rows`` fingerprints is cut into chunks by hash, and
each pair of chunks is traversed in a task of its own.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; equal rows share a component; a component's id is its smallest key,
null keys aside; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.store import forget, kept, written
from tessella.llm.workers import release

SEED = 42
_CHUNK = 1 << 14  # shingles whose bits are counted at once
_LEAF = 64  # a node pair of at most so many element pairs is compared outright
_PAIRS = 1 << 14  # node pairs expanded at once
_WAITING = 1 << 22  # close pairs held before sets are merged
_SAMPLE = 20_000  # documents, about, whose shingles tell which are common
_COMMON = 500_000  # common shingles that the driver holds at most
_FEW = 8  # pairs of a gram for each of its rows that are compared at once
_CROSS = 1 << 18  # pairs of shingle lists compared at once
_TEXTS = 500  # texts cut to shingles at once
_VERIFY = 100  # pairs whose shingle sets are held at once


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of a text, as a signed 64-bit number."""
    words = text.encode().lower().split() if text else []  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    n = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(words) - n + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i:i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp long) of every document row."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(hash_texts, f"`{key}` {kind}, fp long")


def _parts(count: int, budget: int, tree_mean: int) -> int:
    """Fewest parts for which random fingerprints fill a tree with tree_mean on average at most."""
    for parts in range(budget + 1, 2 * budget + 4):
        if count <= tree_mean << (64 * (parts - budget) // parts):
            return parts
    return 2 * budget + 4


def _masks(parts: int, budget: int) -> list[int]:
    """The bits that must agree, for each choice of parts - budget parts, as signed numbers."""
    edges = [64 * i // parts for i in range(parts + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(parts)]
    masks = [sum(part[i] for i in chosen) for chosen in combinations(range(parts), parts - budget)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class _Sets:
    """Connected sets of positions, merged by pairs; the pairs that merged two sets span them.

    Pairs wait until ``settle``, so that which of them span a set depends on the
    pairs and not on the order in which a traversal meets them.
    """

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.spanning: list[np.ndarray] = []
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        if apart.any():
            self.waiting.append((a[apart], b[apart]))
            self.size += int(apart.sum())
            if self.size > _WAITING:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        a, b = (np.concatenate(side) for side in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        a, b = np.minimum(a, b), np.maximum(a, b)
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((b, a, low, high))
            first = order[np.concatenate(([True], np.diff(high[order]) != 0))]
            self.label[high[first]] = low[first]
            self.spanning.append(np.stack([a[first], b[first]], axis=1))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def join_tries(fps: np.ndarray, trees: list[tuple[int, int, int, int]], budget: int, sets: _Sets) -> None:
    """Merge the positions of all linked fingerprints of the given (lo, hi, lo, hi) root pairs. fps: uint64, ascending within each root."""
    stack = [(63, np.array(trees, np.int64).reshape(-1, 4), np.zeros(len(trees), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, nodes, spent = stack.pop()
        if len(nodes) > _PAIRS:
            stack.append((bit, nodes[_PAIRS:], spent[_PAIRS:]))
            nodes, spent = nodes[:_PAIRS], spent[:_PAIRS]
        sizes = (nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2])
        small = (sizes[0] * sizes[1] <= _LEAF) | (bit < 0)
        if small.any():
            _compare(fps, nodes[small], budget, sets)
            nodes, spent = nodes[~small], spent[~small]
        if not len(nodes):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        count = ones[bit]
        middle = [nodes[:, k + 1] - (count[nodes[:, k + 1]] - count[nodes[:, k]]) for k in (0, 2)]
        same = nodes[:, 0] == nodes[:, 2]
        left = (np.stack([nodes[:, 0], middle[0]], 1), np.stack([middle[0], nodes[:, 1]], 1))
        right = (np.stack([nodes[:, 2], middle[1]], 1), np.stack([middle[1], nodes[:, 3]], 1))
        below, costs = [], []
        for i, j in ((0, 0), (1, 1), (0, 1), (1, 0)):
            pair = np.concatenate([left[i], right[j]], axis=1)
            cost = spent + np.int8(i != j)
            keep = (pair[:, 1] > pair[:, 0]) & (pair[:, 3] > pair[:, 2]) & (cost <= budget)
            if (i, j) == (1, 0):
                keep &= ~same
            below.append(pair[keep])
            costs.append(cost[keep])
        nodes, spent = np.concatenate(below), np.concatenate(costs)
        if len(nodes):
            stack.append((bit - 1, nodes, spent))
    sets.settle()


def _compare(fps: np.ndarray, nodes: np.ndarray, budget: int, sets: _Sets) -> None:
    """Compare all element pairs of small node pairs; at bit -1 all elements of a node are equal, so its first stands for it."""
    width = nodes[:, 1] - nodes[:, 0]
    height = nodes[:, 3] - nodes[:, 2]
    big = width * height > _LEAF
    if big.any():  # equal fingerprints in one node: link them in a row
        for lo, hi, lo2, hi2 in nodes[big].tolist():
            run = np.arange(lo, hi)
            other = np.arange(lo2, hi2)
            sets.add(np.concatenate([run[:-1], other[:-1], run[:1]]), np.concatenate([run[1:], other[1:], other[:1]]))
        nodes, width, height = nodes[~big], width[~big], height[~big]
    if not len(nodes):
        return
    total = width * height
    which = np.repeat(np.arange(len(nodes)), total)
    offset = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    a = nodes[which, 0] + offset // height[which]
    b = nodes[which, 2] + offset % height[which]
    near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= budget)
    if near.any():
        sets.add(a[near], b[near])


def _link_units(budgets: list[int], spanning: bool):
    """A task's rows (forest, tree, i, j, chunk, fp, node), sorted, to pairs (a, b) of nodes that connect the connected sets of each unit."""

    def flush(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        forest, tree, i, j, chunk, fp, node = columns
        new = (np.diff(forest) != 0) | (np.diff(tree) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        bounds = np.concatenate(([0], np.flatnonzero(new) + 1, [len(fp)]))
        roots = []
        several = np.diff(bounds) > 1
        for a, b in zip(bounds[:-1][several].tolist(), bounds[1:][several].tolist(), strict=True):
            if i[a] == j[a]:
                roots.append((a, b, a, b))
            else:
                middle = a + int(np.searchsorted(chunk[a:b], j[a]))
                if a < middle < b:
                    roots.append((a, middle, middle, b))
        if not roots:
            return None
        fps = fp.view(np.uint64)
        sets = _Sets(len(fps))
        for budget in budgets:
            join_tries(fps, roots, budget, sets)
        if spanning:
            pairs = np.concatenate(sets.spanning) if sets.spanning else np.empty((0, 2), np.int64)
        else:
            order = np.argsort(sets.label, kind="stable")
            label = sets.label[order]
            chained = np.flatnonzero(label[1:] == label[:-1])
            pairs = np.stack([order[chained], order[chained + 1]], axis=1)
        if not len(pairs):
            return None
        ends = np.sort(node[pairs], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < 1 << 18:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = [c[-1] for c in columns[:4]]
            same = np.logical_and.reduce([c == x for c, x in zip(columns[:4], last, strict=True)])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut and (out := flush([c[:cut] for c in columns])) is not None:
                yield out
            held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if rows and (out := flush([np.concatenate(c) for c in zip(*held, strict=True)])) is not None:
            yield out
        held.clear()
        release()

    return link


def links(prints: DataFrame, *, budget: int = 4, spanning: bool = False, tree_mean: int = 512, tree_rows: int = 1 << 15) -> DataFrame:
    """(a, b), a < b: pairs of nodes whose connected sets are those of all links. prints: rows (node long, fp), nodes unique.

    With ``spanning`` every pair is itself a link, the closer ones first: the
    links that span each tree's connected sets. Otherwise a set's nodes are
    chained, so that none has many pairs.
    """
    count = prints.count()
    parts = _parts(count, budget, tree_mean)
    masks = _masks(parts, budget)
    forests = F.explode(F.array(*[F.struct(F.lit(k).alias("forest"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("tree")) for k, m in enumerate(masks)]))
    rows = prints.select("fp", "node", forests.alias("at")).select("at.forest", "at.tree", "fp", "node")
    # At most 100,000 trees are this large, so their list may be broadcast.
    large = max(tree_rows, count * comb(parts, budget) // 100_000)
    sizes = rows.groupBy("forest", "tree").count().where(F.col("count") > large).withColumn("chunks", F.ceil(F.col("count") / tree_rows).cast("int")).drop("count")
    hot = kept(sizes, "simhash-trees")
    if hot.isEmpty():
        units = rows.select("forest", "tree", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("chunk"), "fp", "node")
    else:
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        others: Column = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
        units = rows.join(F.broadcast(hot), ["forest", "tree"], "left").withColumn("chunk", F.coalesce(chunk, F.lit(0))).withColumn("other", others)
        units = units.select("forest", "tree", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp", "node")
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    dealt = units.repartition("forest", "tree", "i", "j").sortWithinPartitions("forest", "tree", "i", "j", "chunk", unsigned, "node")
    budgets = [b for b in (1, 3) if b < budget] + [budget] if spanning else [budget]
    return dealt.mapInArrow(_link_units(budgets, spanning), "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches, itself included.

    Alternates large-star and small-star steps over written tables. Every step
    keeps the number of rows within that of the edges. Minima are aggregated in
    part before they are shuffled; both sides of the join are plain tables, so
    adaptive execution can split the partition of a node with many neighbours.
    """
    table = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star")
    state = None
    while True:
        # large star: the larger neighbours of a node point to its smallest one
        both = table.union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least")), "star")
        large = both.join(least, both.a == least.node).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        before, table = (table, least), kept(large.distinct(), "star")
        forget(*before)
        # small star: a node and its smaller neighbours point to the smallest of them
        least = kept(table.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), "least"), "star")
        down = table.join(least, table.a == least.node).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        before, table = (table, least), kept(down.union(least.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct(), "star")
        forget(*before)
        now = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            nodes = table.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return nodes.union(table.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        state = tuple(now)


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, budget: int = 4, tree_rows: int = 1 << 15) -> DataFrame:
    """(key, fp, component) of every document row: its fingerprint and the smallest key in its component."""
    prints = written(fingerprints(docs, key=key, text=text, shingle=shingle), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash")
    labels = written(connected(links(distinct.select("fp", F.col("fp").alias("node")), budget=budget, tree_rows=tree_rows)), "simhash")
    grouped = written(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash")
    ids = written(grouped.groupBy("label").agg(F.min("least").alias("component")).withColumnRenamed("label", "of"), "simhash")
    of_print = written(grouped.join(ids, grouped.label == ids["of"]).select(F.col("fp").alias("print"), "component"), "simhash")
    return prints.join(of_print, prints.fp == of_print.print).select(key, "fp", "component")


def _set_print(text: str | None, run: int, seed: int) -> int:
    """The fingerprint of a text's distinct runs of so many words, which an edited word hardly moves."""
    words = text.encode().lower().split() if text else []
    grams = set(words) if run == 1 else {a + b" " + b for a, b in zip(words, words[1:], strict=False)} or set(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i:i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0]) if grams else 0


#: (words of a run, seed) of the fingerprints that propose near copies: words move least, pairs of words tell texts with few different words apart.
PRINTS = ((1, 42), (1, 43), (1, 44), (2, 42))


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = text.encode().lower().split() if text else []
    n = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if n else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def _parity(grams: np.ndarray) -> bytes:
    """For each place of a bit field, by the low bits of a shingle's hash, whether an odd number of the set's shingles falls there; one to two bits a shingle."""
    width = max(64, 1 << len(grams).bit_length())
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(one: bytes, two: bytes) -> int:
    """At least so many shingles are in only one of two sets: a shingle of both changes no place in which their fields differ."""
    x, y = int.from_bytes(one, "little"), int.from_bytes(two, "little")
    wide, width = 8 * max(len(one), len(two)), 8 * min(len(one), len(two))
    while wide > width:  # the lower of the two has nothing to fold
        wide >>= 1
        mask = (1 << wide) - 1
        x, y = (x >> wide ^ x & mask), (y >> wide ^ y & mask)
    return (x ^ y).bit_count()


def _close(pairs: DataFrame, fields: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may have a similarity of ``least`` by their parity fields, so that only these take their whole sets along. fields: rows (node, size, field)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()) * (1 - least) / (1 + least) + 1e-6
            keep = [_apart(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column(3), batch.column(5), most.tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(fields.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("field").alias("x")), "a")
    two = one.join(fields.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("field").alias("y")), "b")
    return two.select("a", "b", "n", "x", "m", "y").mapInArrow(compare, "a long, b long")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have a Jaccard similarity of ``least`` or more. texts: rows (node, text) of all their nodes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, _TEXTS):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_shingles(t.as_py(), shingle).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "grams"])
        release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= least * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    grams = kept(texts.select("node", "text").mapInArrow(sets, "node long, grams binary"), "simhash")
    one = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    two = one.join(grams.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    found = kept(two.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "simhash")
    forget(grams)
    return found


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _least_overlap(least: float, total: np.ndarray) -> np.ndarray:
    """Fewest shingles that sets of ``total`` in sum share if they are similar."""
    return np.ceil(least / (1 + least) * total - 1e-6).astype(np.int64)


def _common(own: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample of the texts repeats, ascending, and how often. They only order shingles, so that common ones are met last."""
    count = own.count()
    share = max(1, count // _SAMPLE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(text.as_py(), shingle).view(np.int64))], names=["gram"])

    sample = own.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select("text").mapInArrow(each, "gram long")
    found = sample.groupBy("gram").agg(F.count("*").cast("int").alias("n")).where("n > 1").orderBy(F.desc("n"), "gram").limit(_COMMON).toArrow()
    grams, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def _prefix(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first of a set's shingles in an order that all sets share: two similar sets have one of these in common. An empty set has 0."""
    if not len(grams):
        return np.zeros(1, np.uint64)
    rank = np.zeros(len(grams), np.int32)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], grams), len(common[0]) - 1)
        rank = np.where(common[0][at] == grams, common[1][at], 0)
    need = int(np.ceil(least * len(grams) - 1e-6))
    return grams[np.lexsort((grams, rank))][:len(grams) - need + 1]


def _cross(least: float, whole: bool):
    """Rows (gram, label, size, place, node), sorted, to pairs (a, b) of one gram that differ in label and may be similar by their sizes and places.

    Unless ``whole``, a gram with many more such pairs than rows gives only a
    few pairs for each row, and its rows again as (gram, size, place, node):
    once the similar ones of these pairs have joined, few or no others are left.
    """

    def may(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, label, size, place, _ = rows
        need = _least_overlap(least, size[a] + size[b])
        left = np.minimum(size[a] - place[a], size[b] - place[b])
        return (label[a] != label[b]) & (left >= need) & (np.minimum(size[a], size[b]) >= need)

    def out(a: np.ndarray, b: np.ndarray | None = None, gram=None, size=None, place=None) -> pa.RecordBatch:
        n = len(a)
        columns = [pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b)]
        columns += [pa.nulls(n, k) if c is None else pa.array(c) for c, k in ((gram, pa.int64()), (size, pa.int32()), (place, pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "gram", "size", "place"])

    def distinct(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1), axis=0)
        return out(pairs[:, 0], pairs[:, 1])

    def few(rows: list[np.ndarray], lo: int, hi: int) -> pa.RecordBatch:
        """Pairs of rows next to each other by size, and of each row with three of the label that has most."""
        gram, label, size, _, node = rows
        at = lo + np.lexsort((node[lo:hi], size[lo:hi]))
        names, counts = np.unique(label[lo:hi], return_counts=True)
        hub = at[label[at] == names[np.argmax(counts)]]
        where = np.searchsorted(size[hub], size[at])
        picked = (node[at] ^ gram[at]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        ends = [(at[:-1], at[1:]), (at[:-2], at[2:])]
        ends += [(at, hub[np.clip(k, 0, len(hub) - 1)]) for k in (where - 1, where, (picked % np.uint64(len(hub))).astype(np.int64))]
        a, b = (np.concatenate(side) for side in zip(*ends, strict=True))
        keep = may(rows, a, b)
        return distinct(node, a[keep], b[keep])

    def flush(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, label, size, place, node = rows
        n = len(gram)
        ends = np.concatenate((np.flatnonzero(np.diff(gram)) + 1, [n]))
        label_ends = np.concatenate((np.flatnonzero((np.diff(gram) != 0) | (np.diff(label) != 0)) + 1, [n]))
        group = np.searchsorted(ends, np.arange(n), side="right")
        first = label_ends[np.searchsorted(label_ends, np.arange(n), side="right")]
        many = ends[group] - first  # partners of a row: those of its gram behind its label
        if not whole:
            starts = np.concatenate(([0], ends[:-1]))
            large = np.bincount(group, many, len(ends)) > _FEW * (ends - starts + _FEW)
            for lo, hi in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
                yield few(rows, lo, hi)
                yield out(node[lo:hi], None, gram[lo:hi], size[lo:hi], place[lo:hi])
            many = np.where(large[group], 0, many)
        own = np.flatnonzero(many)
        reach = np.concatenate(([0], np.cumsum(many[own])))
        at = 0
        while at < reach[-1]:
            upto = min(at + _CROSS, int(reach[-1]))
            which = np.arange(at, upto)
            row = np.searchsorted(reach, which, side="right") - 1
            a = own[row]
            b = first[a] + which - reach[row]
            keep = may(rows, a, b)
            at = upto
            if keep.any():
                yield distinct(node, a[keep], b[keep])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < 1 << 18:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield from flush([c[:cut] for c in columns])
            held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if rows:
            yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])
        held.clear()
        release()

    return cross


def _spread(prefixes: DataFrame) -> DataFrame:
    """Rows (node, label, size, prefix) to rows (gram, label, size, place, node), one for each shingle of a prefix."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, _TEXTS):
            node, label, size, prefix = batch.columns
            grams = [np.frombuffer(v.as_py(), np.int64) for v in prefix]
            n = np.array([len(g) for g in grams])
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [np.concatenate(grams), np.repeat(label.to_numpy(), n), np.repeat(size.to_numpy(), n), place.astype(np.int32), np.repeat(node.to_numpy(), n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "label", "size", "place", "node"])

    return prefixes.select("node", "label", "size", "prefix").mapInArrow(spread, "gram long, label long, size int, place int, node long")


def _unlinked(rows: DataFrame, least: float, whole: bool) -> DataFrame:
    """Pairs (a, b) of nodes of different labels that may have a similarity of ``least``, and as (a, gram, size, place) the rows of grams that have more such pairs. rows: (gram, label, size, place, node)."""
    dealt = rows.repartition("gram").sortWithinPartitions("gram", "label")
    return kept(dealt.mapInArrow(_cross(least, whole), "a long, b long, gram long, size int, place int"), "simhash")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 6) -> DataFrame:
    """(key, component) of the documents in a component of two or more, by exact copies and verified near copies.

    Components are those of all pairs of texts whose whole shingle sets have a
    Jaccard similarity of ``similarity`` or more. Fingerprints of distinct words,
    or distinct pairs of words, within ``budget`` bits propose first: an edit of a
    few words moves these far less than fingerprints of shingles, and the links
    that span each candidate set join most groups at little cost. Similar sets
    share one of the first shingles in any common order, so every other pair that
    may be similar and is not joined yet meets in such a shingle and is verified
    too. A shingle where very many meet first proposes a few pairs for each text,
    as long as these join any, and then all that are left. Keys must be long and unique; rows with a null key are left out.
    """

    columns = [f"fp{k}" for k in range(len(PRINTS))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, _TEXTS):
            texts = [t.as_py() for t in batch.column(1)]
            digests = [xxhash.xxh3_128_digest((t or "").encode()) for t in texts]
            prints = [pa.array([_set_print(t, run, seed) for t in texts], pa.int64()) for run, seed in PRINTS]
            grams = [_shingles(t, shingle) for t in texts]
            sizes = pa.array([len(g) for g in grams], pa.int32())
            prefixes = pa.array([_prefix(g, common.value, similarity).tobytes() for g in grams], pa.binary())
            fields = pa.array([_parity(g) for g in grams], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), *prints, sizes, prefixes, fields], names=["key", "digest", *columns, "size", "prefix", "field"])
        release()

    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(own, shingle))
    signed = kept(own.mapInArrow(sign, "key long, digest binary, " + ", ".join(f"{c} long" for c in columns) + ", size int, prefix binary, field binary"), "simhash")
    classes = kept(signed.groupBy("digest").agg(F.min("key").alias("node"), *(F.min(c).alias(c) for c in columns), F.count("*").alias("n")), "simhash")
    # One kind of fingerprint after the other, as each takes many rows for a text.
    proposed = [kept(links(classes.select("node", F.col(c).alias("fp")), budget=budget, spanning=True), "simhash") for c in columns]

    def verified(pairs: DataFrame) -> DataFrame:
        near = kept(_close(pairs, signed.select(F.col("key").alias("node"), "size", "field"), similarity), "simhash")
        nodes = kept(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "simhash")
        texts = own.join(nodes, own.key == nodes.node, "left_semi").select(F.col("key").alias("node"), "text")
        # Sets of long texts are large, so few pairs go to a worker at once.
        conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(name)
        conf.set(name, str(_VERIFY))
        try:
            found = _similar(near, texts, shingle, similarity)
        finally:
            conf.set(name, before)
        forget(near, nodes)
        return found

    pairs = kept(reduce(DataFrame.union, proposed).distinct(), "simhash")
    forget(*proposed)
    similar = verified(pairs)
    forget(pairs)
    labels = kept(connected(similar).withColumnRenamed("node", "member"), "simhash")
    # Labels join the texts, not the many rows of their prefixes.
    known = classes.join(labels, classes.node == labels.member, "left").select("node", F.coalesce("label", "node").alias("label"))
    rows = _spread(signed.join(known, signed.key == known.node))
    met, tried, last = None, None, False
    while True:
        before, met = met, _unlinked(rows, similarity, last)
        if before is not None:
            forget(before)
        pairs = met.where("b is not null").select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = kept(pairs, "simhash")
        tried = pairs if tried is None else kept(tried.union(pairs), "simhash")
        more = verified(pairs)
        joins = not more.isEmpty()
        if joins:
            similar = similar.union(more)
            labels = kept(connected(similar).withColumnRenamed("node", "member"), "simhash")
        left = met.where("b is null").select("gram", "size", "place", F.col("a").alias("node"))
        if last or left.isEmpty():
            break
        last = not joins
        rows = left.join(labels, left.node == labels.member, "left").select("gram", F.coalesce("label", "node").alias("label"), "size", "place", "node")
    forget(met)
    grouped = kept(classes.join(labels, classes.node == labels.member, "left").where("n > 1 or label is not null").select(F.col("digest").alias("of"), F.coalesce("label", "node").alias("component")), "simhash")
    found = kept(signed.join(grouped, signed.digest == grouped.of).select(F.col("key").alias(key), "component"), "simhash")
    forget(signed, classes, grouped)
    return found


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents less all but the one with the smallest key of each component of ``near_duplicates``, all columns kept."""
    found = near_duplicates(docs, key=key, text=text, **options)
    gone = kept(found.where(F.col(key) != F.col("component")).select(key), "simhash")
    return docs.join(gone, key, "left_anti").select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
