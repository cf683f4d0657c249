"""Sketches as relations: HyperLogLog registers, Bloom filter bits, Merkle levels, LSH bands.

Each is built by an aggregation with a bounded number of groups, so it combines
in part before the shuffle and merges by aggregating again.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import hashing as H


def hll_registers(values: DataFrame, column: str, p: int = 12) -> DataFrame:
    """(bucket, rank): the largest rank of each of 2**p buckets, over the token hashes of a column."""
    bits = H.token_bits(F.col(column).cast("string"))
    bucket = F.shiftrightunsigned(bits, 64 - p)
    rest = F.shiftleft(bits, p)
    # The rank is one more than the leading zeros of the rest.
    binary = F.lpad(F.bin(rest), 64, "0")
    rank = F.when(rest == 0, 64 - p + 1).otherwise(F.instr(binary, "1"))
    return values.where(F.col(column).isNotNull()).select(bucket.alias("bucket"), rank.cast("int").alias("rank")).groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int = 12) -> DataFrame:
    """(estimate): with linear counting up to five times the number of buckets."""
    m = 1 << p
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    sums = registers.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    empty = F.lit(m) - F.col("n")
    raw = alpha * m * m / (F.col("s") + empty)
    return sums.select(F.when((raw <= 5 * m) & (empty > 0), m * F.log(F.lit(float(m)) / empty)).otherwise(raw).alias("estimate"))


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a filter for so many items at this rate of false positives."""
    bits = max(1, ceil(-items * log(rate) / log(2) ** 2))
    return bits, max(1, ceil(bits / max(items, 1) * log(2)))


def bloom_positions(column: Column, bits: int, hashes: int) -> Column:
    """The bits that a value sets."""
    one, two = F.xxhash64(column), F.xxhash64(column, F.lit("second"))
    return F.array(*(F.pmod(F.pmod(one, F.lit(bits)) + i * F.pmod(two, F.lit(bits)), F.lit(bits)) for i in range(hashes)))


def bloom_build(values: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(bit) of a filter over a column."""
    return values.where(F.col(column).isNotNull()).select(F.explode(bloom_positions(F.col(column), bits, hashes)).alias("bit")).distinct()


def bloom_probe(values: DataFrame, column: str, built: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The distinct values whose bits are all set: some may be false positives, none is missing."""
    asked = values.select(column).where(F.col(column).isNotNull()).distinct()
    each = asked.select(column, F.explode(F.array_distinct(bloom_positions(F.col(column), bits, hashes))).alias("bit"))
    need = asked.select(column, F.size(F.array_distinct(bloom_positions(F.col(column), bits, hashes))).alias("need"))
    hits = each.join(built, "bit").groupBy(column).agg(F.count("*").alias("hits"))
    return need.join(hits, column).where("hits = need").select(column)


def merkle_root(leaves: DataFrame, order: str, value: str) -> DataFrame:
    """(root, leaves): SHA-256 over pairs of hashes, level by level, an odd last one moving up as it is. ``order`` counts from 0 without gaps."""
    from tessella.sources.checkpoints import cut

    count = leaves.count()
    level = leaves.select(F.col(order).cast("long").alias("i"), F.sha2(F.col(value).cast("string"), 256).alias("h"))
    n = count
    while n > 1:
        pairs = level.groupBy(F.shiftright("i", 1).alias("i")).agg(F.min(F.struct("i", "h")).alias("a"), F.max(F.struct("i", "h")).alias("b"))
        level = cut(pairs.select("i", F.when(F.col("a.i") == F.col("b.i"), F.col("a.h")).otherwise(F.sha2(F.concat("a.h", "b.h"), 256)).alias("h")))
        n = (n + 1) // 2
    return level.select(F.col("h").alias("root"), F.lit(count).cast("long").alias("leaves"))


def merkle_proof(hashes: list[str], index: int) -> list[tuple[str, str]]:
    """The (side, hash) steps from a leaf to the root, over leaf hashes on the driver."""
    import hashlib

    steps, level = [], list(hashes)
    while len(level) > 1:
        other = index ^ 1
        if other < len(level):
            steps.append(("left" if other < index else "right", level[other]))
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        index //= 2
    return steps


def merkle_verify(value: str, steps: list[tuple[str, str]], root: str) -> bool:
    import hashlib

    at = hashlib.sha256(value.encode()).hexdigest()
    for side, other in steps:
        at = hashlib.sha256((other + at if side == "left" else at + other).encode()).hexdigest()
    return at == root


def simhash(tokens: DataFrame, key: str, token: str) -> DataFrame:
    """(key, simhash long): bit i is 1 if more tokens set it than not, over token hashes; a key without tokens is absent."""
    bits = H.token_bits(F.col(token))
    sums = [F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1).cast("long")) * 2 - 1).alias(f"b{i}") for i in range(64)]
    votes = tokens.select(key, bits.alias("bits")).groupBy(key).agg(*sums)
    parts = [F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    return votes.select(key, reduce(lambda a, b: a.bitwiseOR(b), parts).alias("simhash"))


def lsh_pairs(signatures: DataFrame, key: str, bands: int) -> DataFrame:
    """(a, b) pairs of classes of equal ``signature`` arrays that share a band, named by their smallest keys; each band is a bucket of its own.

    Rows of one signature are one class and add no pairs; ``lsh_classes`` tells who is in it.
    """
    signatures = signatures.groupBy("signature").agg(F.min(key).alias(key))
    width = F.floor(F.size("signature") / bands).cast("int")
    banded = signatures.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.sha2(F.array_join(F.slice("signature", i * width + 1, width).cast("array<string>"), ","), 256).alias("hash")))).alias("b"))
    banded = banded.select(key, "b.band", "b.hash")
    left, right = banded.withColumnRenamed(key, "a"), banded.withColumnRenamed(key, "b")
    return left.join(right, ["band", "hash"]).where("a < b").select("a", "b").distinct()


def lsh_classes(signatures: DataFrame, key: str) -> DataFrame:
    """(key, class): every row with the smallest key of those with the same ``signature``."""
    classes = signatures.groupBy(F.col("signature").alias("_s")).agg(F.min(key).alias("class"))
    return signatures.join(classes, signatures.signature == classes["_s"]).select(key, "class")
