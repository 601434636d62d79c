"""Set algebra over array<long> columns: arrays are sorted and without duplicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(values: Column) -> Column:
    """A set from any array."""
    return F.array_sort(F.array_distinct(values))


def empty() -> Column:
    return F.array().cast("array<bigint>")


def singleton(x: Column) -> Column:
    return F.array(x.cast("long"))


def set_range(n: Column) -> Column:
    """{0, ..., n - 1}"""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(empty())


def cardinality(a: Column) -> Column:
    return F.size(a).cast("long")


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def union_count(a: Column, b: Column) -> Column:
    return (F.size(a) + F.size(b) - F.size(F.array_intersect(a, b))).cast("long")


def intersect_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def difference_count(a: Column, b: Column) -> Column:
    return (F.size(a) - F.size(F.array_intersect(a, b))).cast("long")


def add(a: Column, x: Column) -> Column:
    return F.array_sort(F.array_union(a, F.array(x)))


def remove(a: Column, x: Column) -> Column:
    return F.array_remove(a, x)


def contains(a: Column, x: Column) -> Column:
    return F.array_contains(a, x)


def equal(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def to_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
