"""Name -> query and name -> DuckDB SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import graph


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(graph.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(graph.ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["triangle_top_vertices"](spark, sf_dir)
