"""What the operators share: tables, and hashes of words and shingles over whole texts."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import drop, materialize, remove, settings, shared_dir, shared_path

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Tables of a few numbers a row are broadcast up to this many rows, a bound of some tens of MB; beyond it joins shuffle.
BROADCAST_ROWS = 400_000

__all__ = ["BROADCAST_ROWS", "DOCUMENT_COLUMNS", "drop", "materialize", "mix", "release", "remove", "settings", "shared_dir", "shared_path", "shingle_hashes", "shuffle_partitions", "small", "table", "word_hashes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has few rows; df must be cheap to count."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that this worker has freed back to the system, as Spark keeps workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


# --- words as 64-bit hashes, vectorised over the bytes of a whole text -------------------------

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = (np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)) * _WORD
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each maximal run of bytes other than space and 0x09-0x0D, A-Z lower-cased.

    A word's hash is a polynomial over per-byte random numbers, summed in place and scaled back by the
    inverse base, so the cost is a few array passes a text.
    """
    b = np.frombuffer(text, dtype=np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(b) + 2, bool)
    np.take(_WORD, b, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(b))
    value = (_BYTE_LOWER if lower else _BYTE)[b]
    value *= up
    total = np.add.reduceat(value, start)  # white space counts nothing, so a word's sum may run on to the next word
    total *= down[start]
    total += (end - start).astype(np.uint64)
    return mix(total)


_PLACE = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of `width` words; a shorter text is one shingle, a text without words none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(width, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * _PLACE[i % 5] + np.uint64(i)
    return mix(out + np.uint64(k))
