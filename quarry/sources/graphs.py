"""Where edges come from and where they go: tables, edge-list files, generators, writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import choice, h, h2
from quarry.operators.graph import Graph, normalise


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def together(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Half edges between items that occur in one group: one shuffle by group, one by edge."""
    pairs = rows.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i")).distinct()
    a, b = pairs.alias("a"), pairs.alias("b")
    return a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.i") < F.col("b.i"))).select(F.col("a.i").alias("src"), F.col("b.i").alias("dst")).distinct()


def part_graph(spark: SparkSession, sf_dir: str, isolated: bool = False, flag: str | None = None) -> Graph:
    """Parts bought in one order; all parts as vertices if isolated ones count. A flag keeps lines with that return flag alone."""
    lines = read_table(spark, sf_dir, "lineitem")
    if flag is not None:
        lines = lines.where(F.col("l_returnflag") == flag)
    given = read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id")) if isolated else None
    groups = lines.select(F.col("l_orderkey").cast("long").alias("g"), F.col("l_partkey").cast("long").alias("i"))
    return Graph(together(lines, "l_orderkey", "l_partkey"), given, groups=groups)


def edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """`u v` or `u v w` a line, separated by white space; blank and comment lines are skipped."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(cells.alias("c"))
    out = rows.select(F.col("c")[0].cast("long").alias("src"), F.col("c")[1].cast("long").alias("dst"), *([F.col("c")[2].cast("long").alias("weight")] if weighted else []))
    return out


def graph_from_file(spark: SparkSession, path: str, symmetrize: bool = True) -> Graph:
    """Vertices are 0 to the largest id named, so ids not named are isolated vertices."""
    arcs = edge_list(spark, path)
    top = arcs.agg(F.max(F.greatest("src", "dst")).alias("m")).first().m
    given = spark.range(0, (top if top is not None else -1) + 1).select("id")
    return Graph(normalise(arcs) if symmetrize else arcs, given)


def write_edge_list(edges: DataFrame, path: str, weighted: bool = False) -> None:
    """A line an arc, without loops."""
    columns = ["src", "dst", *(["weight"] if weighted else [])]
    edges.where("src <> dst").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)


def convert(spark: SparkSession, source: str, target: str, weighted: bool = False) -> None:
    """An edge-list file to Parquet: symmetric, without loops or repeated edges, sorted for narrow reads."""
    arcs = edge_list(spark, source, weighted)
    if weighted:
        both = arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    else:
        both = Graph(normalise(arcs)).edges
    both.repartitionByRange("src").sortWithinPartitions("src", "dst").write.parquet(target)


def uniform(spark: SparkSession, scale: int, degree: int = 16, seed: int = 0) -> DataFrame:
    """Half edges of a random graph on 2^scale vertices, from n * degree / 2 hashed pairs."""
    n = 1 << scale
    i = F.col("id")
    rows = spark.range(0, n * degree // 2).select(choice(h(i, 2 * seed + 1), n).alias("src"), choice(h2(i, i, 2 * seed + 2), n).alias("dst"))
    return normalise(rows)


def rmat(spark: SparkSession, scale: int, degree: int = 16, seed: int = 0, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """Half edges of an R-MAT graph: a quadrant of the matrix is chosen by hash at each of `scale` levels."""
    i = F.col("id")
    start = F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"))

    def level(acc, k):
        x = choice(h2(i, k, seed), 10000) / 10000.0
        right = (x >= a) & (x < a + b) | (x >= a + b + c)
        down = x >= a + b
        return F.struct((acc["u"] * 2 + down.cast("long")).alias("u"), (acc["v"] * 2 + right.cast("long")).alias("v"))

    edge = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(scale - 1).cast("long")), start, level)
    return normalise(spark.range(0, (1 << scale) * degree // 2).select(edge.alias("e")).select(F.col("e.u").alias("src"), F.col("e.v").alias("dst")))
