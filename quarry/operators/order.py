"""Vertex orderings (id, rank), their quality and their checks. Ties are broken by id everywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.hashing import h
from quarry.operators import peel
from quarry.operators.graph import Graph, numbered, rounds
from quarry.storage import drop, materialize


def identity(g: Graph) -> DataFrame:
    return numbered(g.vertices, ["id"], "rank")


def random(g: Graph, seed: int = 0) -> DataFrame:
    return numbered(g.vertices.withColumn("key", h(F.col("id"), seed)), ["key", "id"], "rank").select("id", "rank")


def by_degree(g: Graph, descending: bool = False) -> DataFrame:
    first = F.col("degree").desc() if descending else F.col("degree")
    return numbered(g.degrees(), [first, "id"], "rank").select("id", "rank")


def by_triangles(g: Graph) -> DataFrame:
    from quarry.operators.cliques import vertex_triangles

    t = g.vertices.join(vertex_triangles(g), "id", "left").select("id", F.coalesce("tri2", F.lit(0)).alias("tri2"))
    return numbered(t, ["tri2", "id"], "rank").select("id", "rank")


def permuted(arcs: DataFrame, end: str = "out", descending: bool = False) -> DataFrame:
    """(id, rank) of a directed graph's vertices by in- or out-degree; descending is the ascending order reversed."""
    own, other = ("src", "dst") if end == "out" else ("dst", "src")
    ids = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    deg = arcs.groupBy(F.col(own).alias("id")).agg(F.count(other).alias("degree"))
    d = ids.join(deg, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    order = [F.col("degree").desc(), F.col("id").desc()] if descending else ["degree", "id"]
    return numbered(d, order, "rank").select("id", "rank")


# --- peeling ---------------------------------------------------------------------------------


#: Arcs up to which core_numbers() and approximate() peel the graph in one task; they lie in a file, and the task holds some numbers a vertex.
TAIL = 1_000_000_000


def core_numbers(g: Graph, max_rounds: int | None = None, tail: int = TAIL) -> DataFrame:
    """(id, core): the h-index of the neighbours' values, from the degrees down to the fixpoint.

    A graph of no more than `tail` arcs, by their count, is peeled in one task instead, with the same result: every arc is read once, where each of many rounds takes them all.
    """
    peeled = peel.cores(materialize(Graph(g.half).adjacency(), "core-lists"), tail) if max_rounds is None and tail else None
    if peeled is not None:
        out = materialize(peeled, "core")
        return out if g.given is None else g.given.join(out, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core"))
    edges = materialize(g.edges, "core-edges")
    values = materialize(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core")).withColumn("moved", F.lit(True)), "core")
    by_value = Window.partitionBy("src").orderBy(F.col("core").desc())
    for _ in rounds(max_rounds):
        near = edges.join(values.select(F.col("id").alias("dst"), "core"), "dst")
        ranked = near.withColumn("k", F.least(F.row_number().over(by_value).cast("long"), F.col("core")))
        new = ranked.groupBy(F.col("src").alias("id")).agg(F.max("k").alias("new"))
        after = values.join(new, "id").select("id", F.least("core", "new").alias("core"), (F.col("new") < F.col("core")).alias("moved"))
        before, values = values, materialize(after, "core")
        drop(before)
        if values.where("moved").isEmpty():
            break
    out = values.select("id", "core")
    return out if g.given is None else g.given.join(out, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core"))


def _peeled(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int]]:
    """Vertices in smallest-last order, with the neighbours each has left at its removal."""
    import heapq

    nbrs = {int(r.id): [int(x) for x in r.nbrs] for f in frames for r in f.itertuples()}
    degree = {v: len(n) for v, n in nbrs.items()}
    heap = [(d, v) for v, d in degree.items()]
    heapq.heapify(heap)
    done = set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done or d != degree[v]:
            continue
        done.add(v)
        yield v, d
        for w in nbrs[v]:
            if w not in done:
                degree[w] -= 1
                heapq.heappush(heap, (degree[w], w))


def _smallest_last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    order = [v for v, _ in _peeled(frames)]
    yield pd.DataFrame({"id": order, "rank": range(len(order))}).astype("int64")


def degeneracy(g: Graph) -> DataFrame:
    """The exact smallest-last order, smallest id first among ties.

    One vertex after another depends on all before, so this runs in one task and is for graphs that fit it; core_numbers() and approximate() are the distributed forms.
    """
    return g.adjacency().coalesce(1).mapInPandas(_smallest_last, "id long, rank long")


def degeneracy_reversed(g: Graph) -> DataFrame:
    """Ranks n - 1, n - 2, ... in the order of removal, so that the first removed is the highest."""
    r = degeneracy(g)
    n = g.vertices.count()
    return r.select("id", (F.lit(n - 1) - F.col("rank")).alias("rank"))


Boundary = Callable[[DataFrame, float], float]


def average_boundary(left: DataFrame, eps: float) -> float:
    return (1 + eps) * left.agg(F.avg("d").alias("x")).first().x


def min_boundary(left: DataFrame, eps: float) -> float:
    return 2 * (1 + eps) * left.agg(F.min("d").alias("x")).first().x


def _sample(left: DataFrame, eps: float) -> list[int]:
    n = left.count()
    if n <= 3:
        return [r.d for r in left.select("d").collect()]
    size = max(4, int(n ** (0.5 * (0.001 + 1 - min(eps, 1.0)))))
    rows = left.withColumn("k", h(F.col("id"), 7)).orderBy("k", "id").limit(size)  # at most the square root of n
    return [r.d for r in rows.select("d").collect()]


def sampled_min_boundary(left: DataFrame, eps: float) -> float:
    return min(_sample(left, eps))


def sampled_median_boundary(left: DataFrame, eps: float) -> float:
    d = sorted(_sample(left, eps))
    return d[len(d) // 2]


def _first_by_hash(d, eps: float) -> list[int]:
    """_sample() of numbers in the order of their vertices' hashes."""
    n = len(d)
    return d[: n if n <= 3 else max(4, int(n ** (0.5 * (0.001 + 1 - min(eps, 1.0)))))].tolist()


#: The boundaries above, of the neighbours left as an array in the order of the hashes.
LOCAL = {
    average_boundary: lambda d, eps: (1 + eps) * (int(d.sum()) / len(d)),
    min_boundary: lambda d, eps: 2 * (1 + eps) * int(d.min()),
    sampled_min_boundary: lambda d, eps: min(_first_by_hash(d, eps)),
    sampled_median_boundary: lambda d, eps: sorted(x := _first_by_hash(d, eps))[len(x) // 2],
}


def approximate(g: Graph, eps: float = 0.001, boundary: Boundary = average_boundary, max_rounds: int | None = None, tail: int = TAIL) -> DataFrame:
    """Approximate degeneracy order: each round removes all vertices with at most `boundary` neighbours left.

    Ranks follow (round, neighbours left at removal, id). Up to `tail` arcs, by their count, one task goes through the rounds of the boundaries here: a sampled one may take thousands.
    """
    if max_rounds is None and tail and boundary in LOCAL:
        rank = h(F.col("id"), 7) if boundary in (sampled_min_boundary, sampled_median_boundary) else F.lit(0).cast("long")
        lists = materialize(g.adjacency().withColumn("rank", rank), "adg-lists")
        removed = peel.batches(lists, LOCAL[boundary], eps, tail)
        if removed is not None:
            return numbered(materialize(removed, "adg-batches"), ["round", "d", "id"], "rank").select("id", "rank")
    edges = materialize(g.edges, "adg-edges")
    left = materialize(g.degrees().select("id", F.col("degree").alias("d")), "adg-left")
    removed = None
    for round_ in rounds(max_rounds):
        if left.isEmpty():
            break
        limit = max(int(boundary(left, eps)), left.agg(F.min("d").alias("x")).first().x)
        batch = left.where(F.col("d") <= limit).select("id", F.lit(round_).alias("round"), "d")
        batch = materialize(batch, "adg-batch")
        removed = batch if removed is None else removed.unionByName(batch)
        lost = edges.join(batch.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("lost"))
        rest = left.join(batch.select("id"), "id", "left_anti").join(lost, "id", "left").select("id", (F.col("d") - F.coalesce("lost", F.lit(0))).alias("d"))
        before, left = left, materialize(rest, "adg-left")
        drop(before)
    if removed is None:
        return left.select("id", F.col("d").alias("rank"))
    return numbered(removed, ["round", "d", "id"], "rank").select("id", "rank")


# --- converters, quality, checks ---------------------------------------------------------------


def as_sequence(ranks: DataFrame) -> DataFrame:
    """(place, id): the order as a list."""
    return ranks.select(F.col("rank").alias("place"), "id")


def as_ranks(sequence: DataFrame) -> DataFrame:
    return sequence.select("id", F.col("place").alias("rank"))


def later_neighbours(g: Graph, ranks: DataFrame) -> DataFrame:
    """(id, later): neighbours that come after the vertex."""
    arcs = g.orient(ranks)
    n = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("later"))
    return ranks.select("id").join(n, "id", "left").select("id", F.coalesce("later", F.lit(0)).alias("later"))


def width(g: Graph, ranks: DataFrame) -> DataFrame:
    return later_neighbours(g, ranks).agg(F.coalesce(F.max("later"), F.lit(0)).cast("long").alias("width"))


def accuracy(g: Graph, ranks: DataFrame, cores: DataFrame) -> DataFrame:
    """How the order's width compares with the degeneracy: relative error of the width, share of vertices with more later neighbours than the degeneracy, and the mean of their relative excess."""
    top = cores.agg(F.max("core").alias("k"))
    rows = later_neighbours(g, ranks).crossJoin(F.broadcast(top))  # one row
    over = F.when(F.col("later") > F.col("k"), (F.col("later") - F.col("k")) / F.col("k"))
    return rows.agg(
        F.max("k").alias("degeneracy"),
        F.max("later").alias("width"),
        F.round((F.max("later") - F.max("k")) / F.max("k"), 6).alias("relative_error"),
        F.round(F.count(over) / F.count("*"), 6).alias("fault_rate"),
        F.round(F.coalesce(F.avg(over), F.lit(0.0)), 6).alias("mean_excess"),
    )


def is_permutation(ranks: DataFrame) -> DataFrame:
    return ranks.agg(((F.min("rank") == 0) & (F.max("rank") == F.count("*") - 1) & (F.count_distinct("rank") == F.count("*")) & (F.count_distinct("id") == F.count("*"))).alias("is_permutation"))


def monotone_degrees(g: Graph, ranks: DataFrame, descending: bool = False) -> DataFrame:
    """Whether degrees never fall (or rise) along the order."""
    d = ranks.join(g.degrees(), "id")
    after = d.select((F.col("rank") - 1).alias("rank"), F.col("degree").alias("next"))
    ok = F.col("next") <= F.col("degree") if descending else F.col("next") >= F.col("degree")
    return d.join(after, "rank").agg(F.coalesce(F.min(ok.cast("int")), F.lit(1)).cast("boolean").alias("monotone"))


def gap_objective(g: Graph, ranks: DataFrame) -> DataFrame:
    """Sums of the gaps between consecutive neighbours, and between a vertex and its neighbours, under an order."""
    e = g.edges.join(ranks.select(F.col("id").alias("src"), F.col("rank").alias("r")), "src").join(ranks.select(F.col("id").alias("dst"), F.col("rank").alias("s")), "dst")
    gap = F.col("s") - F.lag("s").over(Window.partitionBy("src").orderBy("s"))
    rows = e.withColumn("gap", gap)
    return rows.agg(F.sum("gap").cast("long").alias("neighbour_gaps"), F.sum(F.abs(F.col("r") - F.col("s"))).cast("long").alias("vertex_gaps"))


def averaged(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means of all other columns over trials."""
    others = [c for c in metrics.columns if c not in by]
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in others])


Order = Callable[[Graph], DataFrame]
