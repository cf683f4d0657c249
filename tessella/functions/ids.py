"""Sortable ids: 26 characters of Crockford's base 32, the first ten of which are milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OWN, _HEX = "JKMNPQRSTVWXYZ", "IJKLMNOPQRSTUV"


def is_ulid(text: Column) -> Column:
    return F.upper(text).rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")


def ulid_millis(text: Column) -> Column:
    """Milliseconds since 1970 of an id."""
    return F.conv(F.translate(F.substring(F.upper(text), 1, 10), _OWN, _HEX), 32, 10).cast("long")


def ulid(millis: Column, number: Column) -> Column:
    """An id of a time and a number, the same for the same two and in their order."""
    def digits(value: Column, width: int) -> Column:
        return F.translate(F.lpad(F.conv(value.cast("string"), 10, 32), width, "0"), _HEX, _OWN)

    return F.concat(digits(millis, 10), digits(number, 16))
