"""Token ids in Parquet files that can be read in part.

A file holds documents in ascending doc_id order: doc_id, offset (ids before it in its file),
n_tokens, and ids as a list<int>. Ids take dictionary encoding, the counters delta encoding (format
version 2). Row groups are kept small and pages smaller, and the writer adds column and offset
indexes, so a reader that asks for one doc_id range reads those pages alone, and a reader of the
metadata columns touches no ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import release, shared_path, shuffle_partitions, table
from quarry.llm.tokens import encoder, public_path

SCHEMA = "doc_id long, offset long, n_tokens int, ids array<int>"
#: Pre-tokens that a worker remembers: it has little else to keep here.
REMEMBERED = 900_000
LAYOUT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "maxRecordsPerFile": "0",  # a task writes one file, as offsets count from its first row
}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, before = encoder(path, REMEMBERED, at_once=True), np.array([end_id], "<u4").tobytes(), 0

        def flush(doc_ids, parts, sizes):
            nonlocal before
            n = np.array(sizes, np.int32)
            ends = np.cumsum(n, dtype=np.int64)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)
            out = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before + ends - n), pa.array(n), ids], ["doc_id", "offset", "n_tokens", "ids"])
            before += int(ends[-1])
            return out

        doc_ids, parts, sizes, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                doc_ids.append(doc_id)
                parts.append(ids)
                sizes.append(len(ids) // 4)
                held += len(ids)
                if held > 8 << 20:
                    yield flush(doc_ids, parts, sizes)
                    doc_ids, parts, sizes, held = [], [], [], 0
        if parts:
            yield flush(doc_ids, parts, sizes)
        release()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Encode every text of docs(doc_id, text) and write the files described above to `path`.

    Rows go to files by doc_id range (text breaks ties, so a repeated doc_id is spread too); file
    names ascend with the range. Null text is the empty text; null doc_ids come first.
    """
    spark = docs.sparkSession
    n = partitions or max(shuffle_partitions(spark), 1)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, offset, n_tokens, ids; the bounds on doc_id reach the scan, which skips by page index."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        ends, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
        view = memoryview(values).cast("B")
        crcs = [zlib.crc32(view[4 * int(a) : 4 * int(b)]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "file", "offset", "n_tokens", "ids_crc32"])


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, base): ids in all earlier files; one row per file, from the metadata columns alone."""
    files = spark.read.schema(SCHEMA).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long")).rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("base"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all read from the files."""
    df = spark.read.schema(SCHEMA).parquet(path)
    shape = "doc_id long, file string, offset long, n_tokens long, ids_crc32 long"
    rows = df.select("doc_id", F.col("_metadata.file_name").alias("file"), "offset", "ids").mapInArrow(_digest, shape)
    starts = F.broadcast(file_starts(spark, path))  # one short row per file, so at most as many as the writer had tasks
    return rows.join(starts, "file").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"), end_id=0)
    return token_digests(spark, path)


__all__ = ["LAYOUT", "SCHEMA", "file_starts", "query", "read_tokens", "token_digests", "write_tokens"]
