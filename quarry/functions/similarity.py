"""Similarity of two vertices from the sizes of their neighbourhoods and what they share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ["jaccard", "jaccard_ref", "overlap", "adamic_adar", "resource_allocation", "common_neighbours", "total_neighbours", "preferential_attachment"]


def similarity(metric: str, common: Column, da: Column, db: Column, adamic: Column | None = None, resource: Column | None = None) -> Column:
    """common: shared neighbours; da, db: degrees; adamic, resource: sums of 1 / ln(degree), 1 / degree over shared neighbours.

    `jaccard_ref` has the shared neighbours added in the denominator, an increasing function of `jaccard`.
    """
    if metric == "jaccard":
        return F.when(da + db == 0, F.lit(1.0)).otherwise(F.try_divide(common, da + db - common))
    if metric == "jaccard_ref":
        return F.when(da + db == 0, F.lit(1.0)).otherwise(F.try_divide(common, da + db + common))
    if metric == "overlap":
        return F.try_divide(common, F.least(da, db))
    if metric == "adamic_adar":
        return adamic
    if metric == "resource_allocation":
        return resource
    if metric == "common_neighbours":
        return common.cast("double")
    if metric == "total_neighbours":
        return (da + db - common).cast("double")
    if metric == "preferential_attachment":
        return (da * db).cast("double")
    raise ValueError(f"unknown metric {metric}")
