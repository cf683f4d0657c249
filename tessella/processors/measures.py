"""Measures of byte strings: distribution, information, vector and order statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FIELDS = ["n_bytes", "unique_bytes", "entropy", "redundancy", "mean", "std_dev", "mode_byte", "half_pmi", "magnitude", "sparsity", "transition_rate", "spanning_bytes", "first_half_sum", "second_half_sum"]
_LONG = {"n_bytes", "unique_bytes", "mode_byte", "spanning_bytes", "first_half_sum", "second_half_sum"}


def measure(data: bytes) -> dict[str, float]:
    """All measures of a byte string that is not empty; half_pmi sums p(b) log2(p(b) / (p1(b) p2(b))) over bytes in both halves."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    mean = float((np.arange(256) * counts).sum() / n)
    centered = float((counts * (np.arange(256) - mean) ** 2).sum())
    half = n // 2
    one, two = np.bincount(raw[:half], minlength=256), np.bincount(raw[half:], minlength=256)
    both = (one > 0) & (two > 0)
    pmi = 0.0
    if half and both.any():
        whole = counts[both] / n
        pmi = float((whole * np.log2(whole / ((one[both] / half) * (two[both] / (n - half))))).sum())
    unique = int((counts > 0).sum())
    return {
        "n_bytes": n, "unique_bytes": unique, "entropy": entropy, "redundancy": 1 - entropy / 8, "mean": mean, "std_dev": (centered / n) ** 0.5,
        "mode_byte": int(counts.argmax()), "half_pmi": pmi, "magnitude": centered**0.5, "sparsity": 1 - min(unique, n) / min(256, n),
        "transition_rate": float((raw[1:] != raw[:-1]).sum() / (n - 1)) if n > 1 else 0.0, "spanning_bytes": int((counts > 1).sum()),
        "first_half_sum": int(raw[:half].sum(dtype=np.int64)), "second_half_sum": int(raw[half:].sum(dtype=np.int64)),
    }


def histogram(data: bytes, most: int = 16) -> list[tuple[int, int]]:
    """The most frequent bytes and their counts, ties by byte."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    order = np.lexsort((np.arange(256), -counts))
    return [(int(b), int(counts[b])) for b in order[:most] if counts[b]]


def measures(rows: DataFrame, key: str, data: str) -> DataFrame:
    """(key, *FIELDS) of each row's bytes; null and empty data are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(d) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[c] for f in found], pa.int64() if c in _LONG else pa.float64()) for c in FIELDS)], names=[key, *FIELDS])

    own = rows.select(key, F.col(data).cast("binary").alias("data")).where(F.octet_length("data") > 0)
    kinds = ", ".join(f"{c} {'long' if c in _LONG else 'double'}" for c in FIELDS)
    return own.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {kinds}")
