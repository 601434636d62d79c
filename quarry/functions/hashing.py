"""A hash in plain integer arithmetic, the same in every SQL engine, for reproducible choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483648


def h(x: Column, seed: int | Column = 0) -> Column:
    """x must be 0 <= x < 2^31; so is the result."""
    s = seed if isinstance(seed, Column) else F.lit(seed).cast("long")
    return (x.cast("long") * 1103515245 + s * 12345 + 12345) % MODULUS


def h2(u: Column, v: Column, seed: int | Column = 0) -> Column:
    return h((h(u, seed) * 31 + v.cast("long")) % MODULUS, seed)


def choice(value: Column, k: int | Column) -> Column:
    """0 to k - 1 from the high bits of a hash."""
    return F.floor(value / 65536).cast("long") % k


def sql_h(x: str, seed: int | str = 0) -> str:
    return f"((({x})::BIGINT * 1103515245 + ({seed})::BIGINT * 12345 + 12345) % {MODULUS})"


def sql_h2(u: str, v: str, seed: int | str = 0) -> str:
    inner = f"(({sql_h(u, seed)} * 31 + ({v})::BIGINT) % {MODULUS})"
    return sql_h(inner, seed)


def sql_choice(value: str, k: int | str) -> str:
    return f"(({value} // 65536) % ({k}))"
