"""Half-open intervals [start, end); a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def contains(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (end.isNull() | (at < end))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (e2.isNull() | (s1 < e2)) & (e1.isNull() | (s2 < e1))


def before(e1: Column, s2: Column) -> Column:
    """The first ends no later than the second starts; an open one ends never."""
    return F.coalesce(e1 <= s2, F.lit(False))


def contains_interval(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= s2) & (e1.isNull() | F.coalesce(e2 <= e1, F.lit(False)))


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct(start, end) of the common part, null if there is none."""
    start = F.greatest(s1, s2)
    end = F.least(e1, e2)  # least skips nulls, so an open end gives way
    return F.when(overlaps(s1, e1, s2, e2), F.struct(start.alias("start"), end.alias("end")))


def seconds(start: Column, end: Column) -> Column:
    """Whole seconds, null while open."""
    return F.timestamp_diff("SECOND", start, end)
