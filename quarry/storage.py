"""The shared folder, and tables written there and read again to cut lineage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which every executor sees.

    Where the setting is absent (tests), a folder below the warehouse, which is shared too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While it is true, a query's shuffle files go as soon as the query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python workers and back at a time: whole texts are long, and both sides hold a batch and its copies.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


@contextmanager
def settings(spark: SparkSession, **by_name: str):
    """The session's settings while the block runs."""
    before = {k: spark.conf.get(k, None) for k in by_name}
    for k, v in by_name.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The write's shuffle files are removed at its end, as nothing reads them any more: the disks of executors hold one
    step's shuffles at a time.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with settings(spark, **{CLEANUP: "true", BATCH: str(min(BATCH_ROWS, int(spark.conf.get(BATCH))))}):
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by materialize(), once nothing reads it any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        remove(df.sparkSession, folder)
