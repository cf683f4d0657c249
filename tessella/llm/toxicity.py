"""Toxicity of texts restored through a noisy-channel model.

Restoring. A word with a character that may stand for another or for nothing,
and a row of single letters, becomes a character lattice: each character may
stand for itself, for the letters that it is used for in leetspeak, or, if it
repeats its neighbour, only sets letters apart or is a mark around the word, for
nothing, each at a cost. Addresses and plain numbers stay as they are. The path of least cost under a character
trigram model is the restored word; no state of the search is dropped. The
model's counts come from all texts.

Scoring. Words and word beginnings that labelled toxic texts use at a rate far
above other texts form a lexicon. A text with k lexicon words of n has the
log-likelihood ratio of two Poisson rates, and a logistic curve fitted to the
labelled texts turns that into a score. Only the restored text enters a score;
labels are used for fitting alone.

Fitting takes at most ``train_rows`` labelled texts, those with the smallest
hashes of their ids. All other statistics cover all rows.

Defined cases: null and empty texts have no words and the score of an empty
text; repeated rows score alike; several labels of one id count as their
largest; labelled texts that are copies count once for each label; null ids and null labels are not used for fitting; without both
classes among the labels every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.workers import release

# ---------------------------------------------------------------- characters

_CLASSES = 40
_BREAK = 0
_CLASS = np.zeros(256, np.uint8)
for _c in range(26):
    _CLASS[0x61 + _c] = _CLASS[0x41 + _c] = 1 + _c
_CLASS[0x80:] = 27 + np.arange(128) % 13

#: Fixed letters that other characters stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
}
_SEPARATORS = frozenset(" .-_*·•~'’`,:;/\\+=#^|")
_EDGES = "".join(sorted(_SEPARATORS | set("!?\"()[]{}<>«»“”„&%$§@…¿¡")))
_MARKS = frozenset(_EDGES) & frozenset(LEET)  # marks around a word that may be its letters
_PLAIN = "".join(sorted(frozenset(_EDGES) - _MARKS))
_USUAL = (frozenset("(<*|¡"), frozenset("!*|"))  # of these, those that prose sets before and after words
_FREE = frozenset(LEET) | _SEPARATORS
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_RUN = re.compile(r"(.)\1", re.S)
_LATIN = re.compile("[a-z]")
_ONE = r"(?:[^\W_]|[@$!|+(<€£¡])"
_SPACED = re.compile(rf"(?<![^\s\"'(\[{{«“„]){_ONE}(?:[ .\-_*]{{1,3}}{_ONE}){{2,}}(?![^\s.,;:!?\"')\]}}»”…])")


def classes(text: str) -> np.ndarray:
    """The class of each byte of a text: break, one of the letters a-z, or one of 13 for other bytes of letters."""
    return _CLASS[np.frombuffer(text.encode(), np.uint8)]


def count_trigrams(texts: Iterator[str | None]) -> np.ndarray:
    """Trigram counts over classes, each text between breaks."""
    joined = "  ".join(t for t in texts if t)
    own = classes(f"  {joined}  ").astype(np.int32)
    if len(own) < 3:
        return np.zeros(_CLASSES**3, np.int64)
    return np.bincount((own[:-2] * _CLASSES + own[1:-1]) * _CLASSES + own[2:], minlength=_CLASSES**3)


def trigram_counts(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Trigram counts over every text; what reaches the driver are at most 64,000 sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CLASSES**3, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for i in range(0, len(texts), 500):
                total += count_trigrams(texts.slice(i, 500).to_pylist())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(_CLASSES**3, np.int64)
    for gram, n in rows:
        total[gram] = n
    return total


@dataclass
class Channel:
    """The character model and the costs of the lattice, in nats."""

    cost: list[float]  # by trigram of classes
    substitute: float = 1.2
    keep_symbol: float = 6.0
    drop_repeat: float = 1.0
    drop_second: float = 6.0
    drop_separator: float = 1.5
    drop_edge: float = 1.5
    drop_odd_edge: float = 6.0
    memo: dict[tuple, str] = field(default_factory=dict, repr=False)

    @staticmethod
    def of(counts: np.ndarray) -> Channel:
        cube = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(np.float64)
        pairs = cube.sum(axis=0)
        single = (pairs.sum(axis=0) + 1) / (pairs.sum() + _CLASSES)
        back = (pairs + 20 * single) / (pairs.sum(axis=1, keepdims=True) + 20)
        smooth = (cube + 20 * back[None]) / (cube.sum(axis=2, keepdims=True) + 20)
        return Channel((-np.log(smooth)).reshape(-1).tolist())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def restore(self, word: str, before: int = 0, behind: int = 0) -> str:
        """The likeliest reading of a disguised word in lower case, of which so many marks before and after may be no part.

        Two characters with one reading fix the state of the trigram model, so the
        stretches of characters between such pairs are decoded one by one, and what
        was decoded is remembered by its neighbours: the whole has the least cost.
        """
        out, end, n = [], 0, len(word)
        for start, stop in _stretches(word, before, behind):
            left = word[max(start - 2, 0):start]
            right = word[stop:stop + 2]
            key = (left, word[start:stop], right, min(max(before - start, 0), stop - start), min(max(stop - (n - behind), 0), stop - start))
            found = self.memo.get(key)
            if found is None:
                found = self._decode(*key)
                if stop - start <= 100:
                    if len(self.memo) > 200_000:
                        self.memo.clear()
                    self.memo[key] = found
            out.append(word[end:start])
            out.append(found)
            end = stop
        out.append(word[end:])
        return "".join(out)

    def _decode(self, left: str, free: str, right: str, before: int, behind: int) -> str:
        """The reading of least cost of a stretch between the two characters on either side, or the word's ends."""
        x, y = [_BREAK, _BREAK, *_CLASS[list(left.encode())].tolist()][-2:]
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(x, y): (0.0, None)}
        last, run = left[-1:], 1 if left else 0
        for i, c in enumerate(free):
            run = run + 1 if c == last else 1
            last = c
            options = [(c, 0.0 if c.isalpha() else self.keep_symbol)]
            options += [(letter, self.substitute) for letter in LEET.get(c, "")]
            if run > 1:
                options.append(("", self.drop_second if run == 2 and free[i + 1:i + 2] != c else self.drop_repeat))
            if c in _SEPARATORS:
                options.append(("", self.drop_separator))
            if i < before or i >= len(free) - behind:
                usual = (i < before and c in _USUAL[0]) or (i >= len(free) - behind and c in _USUAL[1])
                options.append(("", self.drop_edge if usual else self.drop_odd_edge))
            coded = [(letter, price, _CLASS[list(letter.encode())].tolist()) for letter, price in options]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for letter, price, codes in coded:
                    x, y, paid = a, b, cost + price
                    for k in codes:
                        paid += self.cost[(x * _CLASSES + y) * _CLASSES + k]
                        x, y = y, k
                    known = after.get((x, y))
                    if known is None or paid < known[0]:
                        after[x, y] = paid, (path, letter) if letter else path
            states = after
        tail = [*_CLASS[list(right.encode())].tolist(), _BREAK][:2]
        best, path = None, None
        for (a, b), (cost, read) in states.items():
            for k in tail:
                cost += self.cost[(a * _CLASSES + b) * _CLASSES + k]
                a, b = b, k
            if best is None or cost < best:
                best, path = cost, read
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def word(self, token: str) -> str:
        """The reading of a token between white space, without the marks around it."""
        core = token.strip(_EDGES)
        form = core if core == token else _form(token, core)
        if form.isalpha():
            alike = not form.isascii() and (_LATIN.search(form) or all(c in LEET for c in form)) and any(c in LEET for c in form)
            return self._known(form) if alike or _RUN.search(form) else form
        if not form:
            return ""
        # Addresses stay as they are, and numbers: nothing tells 455 from a disguise but a mark that no number has.
        if "://" in core or re.search(r"@\w+\.", core):
            return core
        if not any(map(str.isalpha, core)) and any(map(str.isdigit, core)) and not {"@", "$"} & set(form.lstrip("$")):
            return core
        return self._known(form) if _RUN.search(form) or any(c in LEET or c in _SEPARATORS for c in form) else core

    def _known(self, form: str) -> str:
        return self.restore(form, len(form) - len(form.lstrip(_EDGES)), len(form) - len(form.rstrip(_EDGES)))

    def spaced(self, row: str) -> str:
        """The reading of single letters in a row; numbers and marks alone stay as they are."""
        return self._known(row) if any(map(str.isalpha, row)) else row

    def restored(self, text: str | None) -> str:
        """A text in lower case with its disguised words restored, words apart by one space."""
        return " ".join(w for token in tokens(self, text) if (w := self.word(token)))


def _stretches(word: str, before: int, behind: int) -> list[tuple[int, int]]:
    """Where a word's characters have several readings; stretches with fewer than two other characters between them are one."""
    out: list[list[int]] = []
    last, inside = "", len(word) - behind
    for i, c in enumerate(word):
        if c == last or c in _FREE or i < before or i >= inside:
            if out and i - out[-1][1] < 2:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
        last = c
    return out


def _form(token: str, core: str) -> str:
    """A token without the marks around it, save those next to its core that may be letters."""
    if not core:
        return token.strip(_PLAIN)
    at = token.index(core)
    first, last = at, at + len(core)
    while first and token[first - 1] in _MARKS:
        first -= 1
    while last < len(token) and token[last] in _MARKS:
        last += 1
    return token[first:last]


def tokens(channel: Channel, text: str | None) -> list[str]:
    """A text's tokens in lower case; single letters in a row are joined to one."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = _INVISIBLE.sub("", low)
    if _SPACED.search(low):
        low = _SPACED.sub(lambda m: channel.spaced(m[0]), low)
    return low.split()


# ---------------------------------------------------------------- lexicon

_PREFIXES = range(3, 9)


def features(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in _PREFIXES if n <= len(word))]


def _feature_counts(rows: DataFrame, channel) -> DataFrame:
    """(feature, toxic, n, docs) over labelled texts, rows (toxic, text), in part sums; the feature "" counts all words."""

    def sums(totals: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
        columns = ([f for f, _ in totals], [t for _, t in totals], [n for n, _ in totals.values()], [d for _, d in totals.values()])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["feature", "toxic", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = channel.value
        known: dict[str, list[str]] = {}
        totals: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own: dict[str, int] = defaultdict(int)
                for token, n in Counter(tokens(held, text.as_py())).items():
                    found = known.get(token)
                    if found is None:
                        word = held.word(token)
                        found = known[token] = ["", *features(word)] if word else []
                    for f in found:
                        own[f] += n
                for f, n in own.items():
                    total = totals[f, toxic]
                    total[0] += n
                    total[1] += 1
                if len(known) > 30_000:
                    known.clear()
                if len(totals) > 150_000:
                    yield sums(totals)
                    totals.clear()
        yield sums(totals)
        totals.clear()
        known.clear()
        release()

    return rows.select("text", "toxic").mapInArrow(count, "feature string, toxic int, n long, docs long")


@dataclass
class Model:
    """A lexicon, the two rates, and the logistic curve."""

    lexicon: frozenset[str]
    toxic_rate: float
    clean_rate: float
    slope: float
    base: float

    def ratio(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of the two rates, within 20 either way."""
        raw = hits * log(self.toxic_rate / self.clean_rate) - words * (self.toxic_rate - self.clean_rate)
        return np.clip(raw, -20, 20)

    def score(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.slope * self.ratio(hits, words))))

    def hit(self, word: str) -> bool:
        return f"{word}$" in self.lexicon or any(word[:n] in self.lexicon for n in _PREFIXES)


def lexicon(counts: DataFrame, *, least_ratio: float = 12.0, least_docs: int = 5, least_g: float = 30.0) -> frozenset[str]:
    """Features whose rate in toxic texts is far above that in others and whose texts are, by a G test. The counts are those of the texts used for fitting, so their number is bounded by these."""
    total = counts.groupBy("feature").agg(*(F.sum(F.when(F.col("toxic") == t, F.col(c)).otherwise(0)).alias(f"{c}{t}") for t in (0, 1) for c in ("n", "docs"))).cache()
    whole = total.where("feature = ''").first()
    if whole is None or not whole.docs1 or not whole.docs0 or not whole.n1 or not whole.n0:
        total.unpersist()
        return frozenset()
    all_docs = whole.docs0 + whole.docs1

    def term(seen: Column, among: int) -> Column:
        expected = (F.col("docs0") + F.col("docs1")) * (among / all_docs)
        rest = among - seen
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0) + F.when(rest > 0, rest * F.log(rest / (among - expected))).otherwise(0)

    ratio = (F.col("n1") / whole.n1) / ((F.col("n0") + 0.5) / whole.n0)
    g = 2 * (term(F.col("docs1"), whole.docs1) + term(F.col("docs0"), whole.docs0))
    strong = total.where("feature <> ''").where((F.col("docs1") >= least_docs) & (ratio >= least_ratio)).withColumn("g", g).where(F.col("g") >= least_g)
    found = {r.feature: (r.n1, r.n0) for r in strong.collect()}
    total.unpersist()
    return _needed(found, lambda n1, n0: n1 > 0 and (n1 / whole.n1) / ((max(n0, 0) + 0.5) / whole.n0) >= least_ratio)


def _needed(found: dict[str, tuple[int, int]], strong) -> frozenset[str]:
    """The features that are strong by what they cover beyond the longer ones: "abc" goes if all its force is that of "abcd"."""
    kept, longer = set(), defaultdict(lambda: [0, 0])
    for f in sorted(found, key=lambda f: (-len(f.removesuffix("$")), -f.endswith("$"), f)):
        n1, n0 = found[f]
        a, b = longer[f]
        if strong(n1 - a, n0 - b):
            kept.add(f)
        up = f[:-1] if not f.endswith("$") else f[:-1][:_PREFIXES[-1]]
        covered = (n1, n0) if f in kept else (a, b)
        longer[up][0] += covered[0]
        longer[up][1] += covered[1]
    return frozenset(kept)


def held_out(key: str) -> Column:
    """Whether labels of this key are kept from fitting."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _signature(text: str | None) -> bytes:
    """The smallest hashes of a text's runs of five words under three seeds; near copies mostly share all three, texts with a passage in common do not."""
    words = (text or "").lower().encode().split()
    runs = list(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else [words]
    hashes = np.fromiter((crc32(b" ".join(run)) for run in runs), np.uint64, len(runs))
    return b"".join(int((hashes * np.uint64(odd) & np.uint64(0xFFFFFFFF)).min()).to_bytes(4, "big") for odd in (1, 0x9E3779B1, 0x85EBCA77))


def _apart(rows: DataFrame) -> DataFrame:
    """One of the labelled texts that share label and signature: copies are no further evidence, but copies with both labels are evidence of both."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("signature", pa.array([_signature(t.as_py()) for t in batch.column(1)], pa.binary()))

    signed = rows.mapInArrow(sign, "toxic int, text string, signature binary")
    return signed.groupBy("toxic", "signature").agg(F.min("text").alias("text")).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = 20_000) -> tuple[Channel, Model]:
    """The character model of all texts and the toxicity model of the labelled ones that are not held out."""
    spark = docs.sparkSession
    channel = Channel.of(trigram_counts(docs, text=text))
    held = spark.sparkContext.broadcast(channel)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64(key), key).limit(train_rows).withColumnRenamed(key, "_id")
    chosen = spark.createDataFrame([(r["_id"], r["toxic"]) for r in known.collect()], known.schema)  # train_rows at most
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("toxic", "text")
    rows = _apart(rows)
    found = lexicon(_feature_counts(rows, held))
    empty = Model(found, 0.02, 0.0002, 0.0, 0.0)
    counts = np.array(_hits(rows, held, spark.sparkContext.broadcast(empty), ["toxic"]).collect(), np.float64).reshape(-1, 3)
    return channel, _curve(found, counts)


def _curve(found: frozenset[str], counts: np.ndarray) -> Model:
    """Rates and curve from (toxic, hits, words) of the labelled texts."""
    toxic, hits, words = counts.T
    share = min(max(float(toxic.mean()) if len(toxic) else 0.0, 1e-9), 1 - 1e-9)
    base = log(share / (1 - share))
    if not found or not hits.any():
        return Model(found, 0.02, 0.0002, 0.0, base)
    marked = (toxic == 1) & (hits > 0)
    clean = toxic == 0
    high = (hits[marked].sum() + 0.5) / (words[marked].sum() + 1)
    low = (hits[clean].sum() + 0.5) / (words[clean].sum() + 1)
    model = Model(found, float(max(high, 4 * low)), float(low), 0.0, base)
    x = model.ratio(hits, words)
    weights = np.array([base, 0.5])
    design = np.stack([np.ones_like(x), x], axis=1)
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(design @ weights)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (toxic - p) - ridge @ (weights - [0, 0.5]))
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.base, model.slope = float(weights[0]), float(max(weights[1], 0))
    return model


class _Counter:
    """Counts the lexicon words and all words of texts; what it learns of tokens stays with the Python worker."""

    def __init__(self, channel: Channel, model: Model):
        self.channel, self.model = channel, model
        self._forget(_KNOWN.get(None) is not model)

    def _forget(self, when: bool) -> None:
        if when:
            _KNOWN.clear()
            _KNOWN[None] = self.model

    def __call__(self, text: str | None) -> tuple[int, int]:
        own = tokens(self.channel, text)
        found = list(map(_KNOWN.get, own))
        if None in found:
            self._forget(len(_KNOWN) > 250_000)
            for i, f in enumerate(found):
                if f is None:
                    token = own[i]
                    f = _KNOWN.get(token)
                    if f is None:
                        word = self.channel.word(token)
                        f = _KNOWN[token] = (2 if self.model.hit(word) else 1) if word else 0
                    found[i] = f
        counts = bytes(found)
        if 2 in counts:
            # A line that repeats is evidence once: words count by the pairs that they end.
            counts = bytes(dict(zip(zip([None, *own], own, strict=False), counts, strict=False)).values())
        return counts.count(2), len(counts) - counts.count(0)


def _hits(rows: DataFrame, channel, model, extra: list[str]) -> DataFrame:
    """(extra..., hits, words): lexicon words and all words of each row's text."""

    def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter(channel.value, model.value)
        for batch in batches:
            found = [count(t.as_py()) for t in batch.column(len(extra))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(extra)], pa.array([h for h, _ in found], pa.int64()), pa.array([w for _, w in found], pa.int64())], names=[*extra, "hits", "words"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in extra)
    return rows.select(*extra, "text").mapInArrow(count_texts, f"{kinds}, hits long, words long")


#: What a Python worker remembers of tokens: 0 no word, 1 a word, 2 a lexicon word. None holds the model it belongs to.
_KNOWN: dict = {}


def score(docs: DataFrame, channel: Channel, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, hits, words, score, predicted) of every row, by its whole restored text."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    found = _hits(rows, context.broadcast(channel), context.broadcast(model), [key])
    raw = F.col("hits") * log(model.toxic_rate / model.clean_rate) - F.col("words") * (model.toxic_rate - model.clean_rate)
    ratio = F.greatest(F.least(raw, F.lit(20.0)), F.lit(-20.0))
    value = 1 / (1 + F.exp(-(model.base + model.slope * ratio)))
    return found.withColumn("score", value).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, channel: Channel, model: Model, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, all columns kept."""
    context = docs.sparkSession.sparkContext
    held, fitted = context.broadcast(channel), context.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter(held.value, fitted.value)
        for batch in batches:
            found = np.array([count(t.as_py()) for t in batch.column(at)], np.float64).reshape(-1, 2)
            yield batch.filter(pa.array(fitted.value.score(found[:, 0], found[:, 1]) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def restore(docs: DataFrame, channel: Channel, *, text: str = "text") -> DataFrame:
    """Adds ``restored``: every text in lower case with its disguised words restored; a column of that name is replaced."""
    docs = docs.drop("restored")
    held = docs.sparkSession.sparkContext.broadcast(channel)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("restored", pa.array([held.value.restored(t.as_py()) for t in batch.column(at)], pa.string()))

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", restored string")
