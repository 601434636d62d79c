"""Undirected graphs as DataFrames: vertices(id), half(src < dst), and what follows from them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.storage import materialize


def rounds(limit: int | None) -> Iterator[int]:
    """0, 1, 2, ... for a loop that breaks at its fixpoint; raises where a limit given is passed with work left."""
    yield from itertools.count() if limit is None else range(limit + 1)
    raise RuntimeError(f"not done after {limit} rounds")


def normalise(pairs: DataFrame) -> DataFrame:
    """Any pairs (src, dst) to half edges: no loops, each undirected edge once, src < dst."""
    return pairs.where("src <> dst").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).distinct()


@dataclass
class Graph:
    """half: each edge once with src < dst. vertices: ids; by default those with an edge.

    groups(g, i): where the edges come from, items in one group. near(id, nbrs): neighbourhoods in the shared folder, without isolated vertices.
    """

    half: DataFrame
    given: DataFrame | None = None
    _made: dict = field(default_factory=dict, repr=False)
    groups: DataFrame | None = None
    near: DataFrame | None = None

    @classmethod
    def from_edges(cls, pairs: DataFrame, vertices: DataFrame | None = None, normalised: bool = False) -> Graph:
        return cls(pairs if normalised else normalise(pairs), vertices)

    def kept(self) -> Graph:
        """The same graph with its edges written to the shared folder, for plans that read them often."""
        return Graph(materialize(self.half, "half-edges"), self.given)

    def listed(self) -> Graph:
        """The same graph with its neighbourhoods written to the shared folder, straight from groups where it has them."""
        if self.near is not None:
            return self
        if self.groups is not None:
            from quarry.operators.rooted import neighbours

            lists = neighbours(self.groups)
        else:
            lists = Graph(self.half).adjacency()
        near = materialize(lists, "adjacency")
        half = near.select(F.col("id").alias("src"), F.explode(F.filter("nbrs", lambda x: x > F.col("id"))).alias("dst"))
        return Graph(half, self.given, near=near)

    @property
    def edges(self) -> DataFrame:
        """Both directions, in one scan of the half edges."""
        return self.half.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")

    @property
    def vertices(self) -> DataFrame:
        if self.given is None and self.near is not None:
            return self.near.select("id")
        return self.given if self.given is not None else self.edges.select(F.col("src").alias("id")).distinct()

    def degrees(self) -> DataFrame:
        """(id, degree) of every vertex, 0 for isolated ones."""
        d = self.near.select("id", F.size("nbrs").cast("long").alias("degree")) if self.near is not None else self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return d if self.given is None else self.given.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def adjacency(self) -> DataFrame:
        """(id, nbrs): sorted neighbourhoods, empty for isolated vertices."""
        a = self.near if self.near is not None else self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))
        return a if self.given is None else self.given.join(a, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))

    def by_degree(self) -> DataFrame:
        """(src, dst) with the end of smaller (degree, id) as src: out-degrees are small even at hubs."""
        d = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        e = self.half.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
        first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
        return e.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"))

    def orient(self, rank: DataFrame, relabel: bool = False) -> DataFrame:
        """(src, dst) from the lower to the higher rank; the ends are the ranks themselves if relabelled."""
        r = lambda end: rank.select(F.col("id").alias(end), F.col("rank").alias(f"r{end}"))
        e = self.edges.join(r("src"), "src").join(r("dst"), "dst").where(F.col("rsrc") < F.col("rdst"))
        return e.select(F.col("rsrc").alias("src"), F.col("rdst").alias("dst")) if relabel else e.select("src", "dst")

    def without_isolated(self) -> DataFrame:
        """(id, new_id): vertices with an edge, numbered from 0 in the order of their ids."""
        return numbered(self.edges.select(F.col("src").alias("id")).distinct(), ["id"], "new_id")

    def induced(self, ids: DataFrame) -> DataFrame:
        """Half edges with both ends among ids(id)."""
        keep = ids.select("id").distinct()
        e = self.half.join(keep.withColumnRenamed("id", "src"), "src", "left_semi")
        return e.join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")

    def connected(self, pairs: DataFrame) -> DataFrame:
        """pairs(u, v) with `connected`: whether the edge u-v is there."""
        e = self.half.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("hit"))
        return pairs.join(e, (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b")), "left").select("u", "v", F.coalesce("hit", F.lit(False)).alias("connected"))

    def stats(self) -> DataFrame:
        d = self.degrees()
        return d.agg(
            F.count("*").alias("n"), F.floor(F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("m"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.round(F.avg("degree"), 6).alias("mean_degree")
        )


def is_directed(arcs: DataFrame) -> DataFrame:
    """One row: whether any arc lacks its reverse."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    missing = arcs.select("src", "dst").distinct().join(back, ["src", "dst"], "left_anti")
    return missing.agg((F.count("*") > 0).alias("directed"))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with 0, 1, 2, ... in the order given, without bringing all rows to one task.

    Rows are range partitioned by the order; each partition's numbers start after those before it.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt.withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_s") + F.col("_k")).cast("long")).drop("_p", "_k", "_s")
