"""Hash expressions and sketch parts that are exact without Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TWO64 = 1 << 64


def content_hash(text: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    """The first 16 bytes of the SHA-256 in hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def token_hash(token: Column) -> Column:
    """The first 8 bytes of the SHA-256 as an unsigned little-endian number, in decimal(20,0)."""
    first = F.substring(F.sha2(token, 256), 1, 16)
    swapped = F.concat(*(F.substring(first, 15 - 2 * i, 2) for i in range(8)))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def token_bits(token: Column) -> Column:
    """The same 64 bits as a signed long."""
    first = F.substring(F.sha2(token, 256), 1, 16)
    swapped = F.concat(*(F.substring(first, 15 - 2 * i, 2) for i in range(8)))
    high, low = (F.conv(F.substring(swapped, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def minhash(hashes: Column, k: int) -> Column:
    """k minima of hash * c mod 2**64 with c = 1000003 * (i + 1) + 1000009, over an array of decimal(20,0) hashes."""
    whole = F.transform(hashes, lambda h: h.cast("decimal(38,0)"))
    modulus = F.lit(str(_TWO64)).cast("decimal(20,0)")

    def slot(i: int) -> Column:
        factor = F.lit(str(1000003 * (i + 1) + 1000009)).cast("decimal(10,0)")
        return F.array_min(F.transform(whole, lambda h: (h * factor).cast("decimal(38,0)") % modulus)).cast("decimal(20,0)")

    return F.array(*map(slot, range(k)))
