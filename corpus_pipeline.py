"""Documents to packed sequences: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which run() writes as Parquet to the
shared folder and reads again for the next.

Every stage keeps the columns of its documents but the last, whatever they are called, and gives no
rows for an empty table. Null and empty texts have no words: the quality rules reject them; by
themselves, the near-duplicate stage keeps each, the leak stage keeps them, personal data leaves them
as they are, and packing makes them the end token alone. Texts of any length are read whole. Rows
equal in doc_id and text are each judged alike, but the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, ngram_join, packing, pii, quality
from quarry.llm.common import materialize, table
from quarry.llm.tokens import public_path
from quarry.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the rule ledger accepts."""
    return quality.keep(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of n-gram Jaccard links: that with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in windows of benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms."""
    return pii.clean(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Neither near duplicates by exact Jaccard links nor packing is SQL; the stages are tested against brute force.
ORACLE_SQL = None
