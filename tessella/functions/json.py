"""Canonical JSON, encodings, and hashes that need a loop over bytes."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

FORMS = ("sorted", "lower", "trimmed", "full")


def canonical(text: str | None, form: str = "full") -> str | None:
    """JSON with sorted keys; also keys and texts in lower case (lower), white space in texts collapsed (trimmed), or all (full). What is no JSON is null."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None

    def word(s: str) -> str:
        if form in ("trimmed", "full"):
            s = " ".join(s.split())
        return s.lower() if form in ("lower", "full") else s

    def walk(v: object) -> object:
        if isinstance(v, dict):
            return {word(k) if form in ("lower", "full") else k: walk(x) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x) for x in v]
        return word(v) if isinstance(v, str) else v

    return json.dumps(walk(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(column: Column, form: str = "full") -> Column:
    """``canonical`` of a column, by Arrow batches."""
    if form not in FORMS:
        raise ValueError(f"form is one of {FORMS}")

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: canonical(t, form), na_action="ignore")

    return run(column)


def same_json(a: Column, b: Column) -> Column:
    """Whether two values have one JSON text."""
    return F.to_json(F.struct(a.alias("v"))).eqNullSafe(F.to_json(F.struct(b.alias("v"))))


def fnv1a(data: bytes) -> int:
    """FNV-1a over bytes, 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_hex(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: f"{fnv1a(t.encode()):016x}", na_action="ignore")

    return run(column)


def ngram_vector(data: bytes, dims: int = 64, longest: int = 4) -> np.ndarray:
    """Counts of the hashed byte n-grams of a text, scaled to length 1; zeros for an empty one."""
    out = np.zeros(dims)
    for n in range(1, longest + 1):
        for i in range(len(data) - n + 1):
            out[fnv1a(data[i:i + n]) % dims] += 1
    size = np.sqrt((out * out).sum())
    return out / size if size else out


def ngram_embedding(column: Column, dims: int = 64) -> Column:
    """``ngram_vector`` of a column, by Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: ngram_vector((t or "").encode(), dims).astype(np.float32))

    return run(column)


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of words by their relative counts, case kept; 0 if either is empty."""
    terms = F.array_union(a, b)

    def count(words: Column, t: Column) -> Column:
        return F.size(F.filter(words, lambda w: w == t)).cast("double")

    def total(f) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + f(t))

    dot = total(lambda t: count(a, t) * count(b, t))
    scale = F.sqrt(total(lambda t: count(a, t) * count(a, t))) * F.sqrt(total(lambda t: count(b, t) * count(b, t)))
    return F.when(scale == 0, 0.0).otherwise(dot / scale)
