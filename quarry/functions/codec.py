"""Compressed adjacency: sizes as SQL expressions, and codecs on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values below this have a variable-length code.
VARINT_LIMIT = 1 << 56


def bits(x: Column) -> Column:
    """Bits that hold x (1 for 0)."""
    return F.greatest(F.lit(1), F.length(F.bin(x))).cast("long")


def varint_length(x: Column) -> Column:
    """Bytes of x at seven bits a byte; null from 2^56 on."""
    out = F.when(x < 0, F.lit(None))
    for n in range(1, 9):
        out = out.when(x < F.lit(1 << (7 * n)).cast("long"), F.lit(n))
    return out.cast("long")


def gaps(nbrs: Column) -> Column:
    """First neighbour, then differences of consecutive ones."""
    return F.transform(nbrs, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(nbrs, i - 1)))


def zigzag(x: Column) -> Column:
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


def sizes(adjacency: DataFrame, n: Column) -> DataFrame:
    """Per vertex: k-bit size with the global and the own width, gap-coded k-bit size, and varint bytes of degree, sign, first difference and gaps."""
    a = adjacency.withColumn("degree", F.size("nbrs").cast("long")).withColumn("g", gaps(F.col("nbrs")))
    most = lambda c: F.coalesce(F.array_max(c), F.lit(0))
    rest = F.aggregate(F.transform(F.slice("g", 2, F.greatest(F.size("g"), F.lit(1))), varint_length), F.lit(0).cast("long"), lambda s, x: s + x)
    first = F.when(F.size("g") > 0, varint_length(F.abs(F.get("nbrs", F.lit(0)) - F.col("id"))) + 1).otherwise(F.lit(0))
    return a.select(
        "id", "degree", (F.col("degree") * bits(n)).cast("long").alias("kbit"), (F.col("degree") * bits(most("nbrs"))).cast("long").alias("kbit_local"), (F.col("degree") * bits(most("g"))).cast("long").alias("kbit_gap"),
        (varint_length(F.col("degree")) + first + rest).cast("long").alias("varint_bytes"),
    )


def to_varint(x: int) -> bytes:
    if not 0 <= x < VARINT_LIMIT:
        raise ValueError(f"{x} has no code")
    out = bytearray()
    while x >= 128:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def from_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value at a place, and the place after it."""
    x = shift = 0
    while True:
        b = data[at]
        x |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return x, at


def encode_neighbours(vertex: int, nbrs: list[int]) -> bytes:
    """Degree, sign of the first neighbour's difference to the vertex, the difference, and the gaps."""
    if not nbrs:
        return to_varint(0)
    d = nbrs[0] - vertex
    out = [to_varint(len(nbrs)), bytes([d < 0]), to_varint(abs(d))]
    return b"".join(out + [to_varint(b - a) for a, b in zip(nbrs, nbrs[1:])])


def decode_neighbours(vertex: int, data: bytes) -> list[int]:
    n, at = from_varint(data)
    if not n:
        return []
    negative = data[at]
    d, at = from_varint(data, at + 1)
    out = [vertex - d if negative else vertex + d]
    while len(out) < n:
        gap, at = from_varint(data, at)
        out.append(out[-1] + gap)
    return out


def pack_bits(values: list[int], width: int) -> bytes:
    """values at `width` bits each, lowest bits first."""
    total = 0
    for i, x in enumerate(values):
        if x >> width:
            raise ValueError(f"{x} is wider than {width} bits")
        total |= x << (i * width)
    return total.to_bytes((len(values) * width + 7) // 8, "little")


def unpack_bits(data: bytes, width: int, n: int) -> list[int]:
    total, mask = int.from_bytes(data, "little"), (1 << width) - 1
    return [(total >> (i * width)) & mask for i in range(n)]


def tree_size(values: list[int], width: int) -> int:
    """Bits of a binary tree over the values' bits, highest first: two marks a node that is no leaf, and one bit where a subtree is a full interval."""
    def size(low: int, high: int, level: int) -> int:
        if low == high:
            return 0
        if high - low == 1 << level:
            return 1
        if level == 0:
            return 0
        mid = low
        bit = 1 << (level - 1)
        while mid < high and not values[mid] & bit:
            mid += 1
        return 3 + size(low, mid, level - 1) + size(mid, high, level - 1)

    return size(0, len(values), width)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [encode_neighbours(v, n or []) for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "data"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nbrs = [decode_neighbours(v, d) for v, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nbrs, pa.list_(pa.int64()))], ["id", "nbrs"])


def encode(adjacency: DataFrame) -> DataFrame:
    """(id, nbrs) to (id, data)."""
    return adjacency.select("id", "nbrs").mapInArrow(_encode, "id long, data binary")


def decode(encoded: DataFrame) -> DataFrame:
    return encoded.select("id", "data").mapInArrow(_decode, "id long, nbrs array<bigint>")
