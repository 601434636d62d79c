"""Breadth-first search, shortest paths, PageRank and betweenness as loops over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import h
from quarry.operators import peel
from quarry.operators.components import components as connected
from quarry.operators.graph import Graph, rounds
from quarry.storage import drop, materialize

#: Arcs up to which pagerank() and components() go through their rounds in one task, with the arcs in a file.
TAIL = 1_000_000_000


def source(g: Graph) -> int:
    """The smallest id with an edge."""
    return g.half.agg(F.min("src").alias("s")).first().s


def sources(g: Graph, n: int, seed: int = 0) -> list[int]:
    """n vertices with an edge, by hash."""
    ids = g.edges.select(F.col("src").alias("id")).distinct()
    return [r.id for r in ids.orderBy(h(F.col("id"), seed), "id").limit(n).collect()]


def bfs(g: Graph, start: int, arcs: DataFrame | None = None) -> DataFrame:
    """(id, depth, parent): the parent is the smallest neighbour one level up; the start is its own. Unreached vertices are absent."""
    edges = materialize(g.edges if arcs is None else arcs, "bfs-edges")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0, start)], "id long, depth long, parent long")
    front, depth = seen, 0
    parts = [materialize(seen, "bfs-level")]
    while True:
        depth += 1
        reached = edges.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        done = parts[0]
        for p in parts[1:]:
            done = done.unionByName(p)
        front = materialize(reached.join(done, "id", "left_anti").select("id", F.lit(depth).cast("long").alias("depth"), "parent"), "bfs-level")
        if front.isEmpty():
            return done
        parts.append(front)


def sssp(edges: DataFrame, start: int, max_rounds: int | None = None) -> DataFrame:
    """(id, dist) from edges(src, dst, weight), weights not negative: each round relaxes the arcs of the vertices that improved."""
    edges = materialize(edges, "sssp-edges")
    dist = materialize(edges.sparkSession.createDataFrame([(start, 0, True)], "id long, dist long, moved boolean"), "dist")
    for _ in rounds(max_rounds):
        front = dist.where("moved").select(F.col("id").alias("src"), "dist")
        offer = edges.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("weight")).alias("offer"))
        both = dist.select("id", "dist").join(offer, "id", "full").select("id", F.least("dist", "offer").alias("dist"), (F.col("dist").isNull() | (F.col("offer") < F.col("dist"))).alias("moved"))
        before, dist = dist, materialize(both.select("id", "dist", F.coalesce("moved", F.lit(False)).alias("moved")), "dist")
        drop(before)
        if dist.where("moved").isEmpty():
            break
    return dist.select("id", "dist")


def components(g: Graph, tail: int = TAIL) -> DataFrame:
    """(id, component): the smallest id of the component; isolated vertices are their own. Up to `tail` arcs, by their count, are one task's work."""
    label = peel.labels(materialize(Graph(g.half).adjacency(), "cc-lists"), tail) if tail else None
    label = connected(g.half).withColumnRenamed("label", "component") if label is None else materialize(label, "cc")
    return label if g.given is None else g.given.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").cast("long").alias("size"))


def pagerank(arcs: DataFrame, iterations: int = 20, damping: float = 0.85, tolerance: float | None = 1e-4, cut: int = 5, tail: int = TAIL) -> DataFrame:
    """(id, rank): every vertex pulls rank / out-degree from its in-neighbours; what has no out-arc keeps nothing for others.

    Up to `tail` arcs, by their count, are one task's work, as rounds over tables shuffle all arcs each time. There the arcs carry their out-degree, so a round is one join and one sum; lineage is cut every few rounds.
    """
    if tail:
        came = arcs.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("nbrs"))
        went = arcs.select(F.col("src").alias("id"), F.array().cast("array<bigint>").alias("none")).distinct()
        lists = came.join(went, "id", "full").select("id", F.coalesce("nbrs", "none").alias("nbrs"))
        found = peel.ranks(materialize(lists, "pr-lists"), iterations, damping, tolerance, tail)
        if found is not None:
            return materialize(found, "pr")
    ids = materialize(arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "pr-ids")
    n = ids.count()
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    arcs = materialize(arcs.join(out, "src"), "pr-arcs")
    ranks = ids.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    base = (1 - damping) / max(n, 1)
    for i in range(iterations):
        last = tolerance is not None or i % cut == cut - 1 or i == iterations - 1
        got = arcs.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = ids.join(got, "id", "left").select("id", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if last:
            new = materialize(new, "pr")
        if tolerance is not None:
            moved = new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("x")).first().x
            if moved < tolerance:
                return new
        ranks = new
    return ranks


def betweenness(g: Graph, starts: list[int]) -> DataFrame:
    """(id, score): Brandes' dependencies summed over the starts, over the largest (0 if that is 0)."""
    edges = materialize(g.edges, "bc-edges")
    spark, total = edges.sparkSession, None
    for start in starts:
        levels = [materialize(spark.createDataFrame([(start, 0, 1.0)], "id long, depth long, paths double"), "bc-level")]
        while True:
            done = levels[0]
            for p in levels[1:]:
                done = done.unionByName(p)
            nxt = edges.join(levels[-1].select(F.col("id").alias("src"), "paths"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
            nxt = materialize(nxt.join(done, "id", "left_anti").select("id", F.lit(len(levels)).cast("long").alias("depth"), "paths"), "bc-level")
            if nxt.isEmpty():
                break
            levels.append(nxt)
        delta = levels[-1].select("id", "paths", F.lit(0.0).alias("delta"))
        parts = [materialize(delta, "bc-delta")]
        for level in reversed(levels[:-1]):
            below = parts[-1].select(F.col("id").alias("dst"), ((1.0 + F.col("delta")) / F.col("paths")).alias("share"))
            up = edges.join(below, "dst").join(level.select(F.col("id").alias("src"), "paths"), "src").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("paths") * F.col("share")).alias("delta"))
            parts.append(materialize(level.select("id", "paths").join(up, "id", "left").select("id", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")), "bc-delta"))
        scores = parts[0].select("id", "delta")
        for p in parts[1:]:
            scores = scores.unionByName(p.select("id", "delta"))
        scores = scores.where(F.col("id") != start)
        total = scores if total is None else total.unionByName(scores)
    sums = g.vertices.join(total.groupBy("id").agg(F.sum("delta").alias("s")), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))
    sums = materialize(sums, "bc")
    top = sums.agg(F.max("s").alias("m")).first().m or 0.0
    return sums.select("id", (F.col("s") / top if top else F.lit(0.0)).alias("score"))


def top(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k rows with the largest value, ties to the smallest id."""
    return df.orderBy(F.desc(column), "id").limit(k)


# --- checks ----------------------------------------------------------------------------------


def bfs_check(g: Graph, tree: DataFrame) -> DataFrame:
    """Vertices reached, tree arcs that are no edge or skip a level, and edges whose depths differ by more than one or that leave the tree."""
    up = tree.join(tree.select(F.col("id").alias("parent"), F.col("depth").alias("above")), "parent")
    wrong_depth = up.where((F.col("id") != F.col("parent")) & (F.col("depth") != F.col("above") + 1)).agg(F.count("*").cast("long").alias("wrong_depth"))
    arcs = tree.where("id <> parent").select(F.col("parent").alias("u"), F.col("id").alias("v"))
    no_edge = g.connected(arcs).where("not connected").agg(F.count("*").cast("long").alias("no_edge"))
    d = tree.select("id", "depth")
    e = g.half.join(d.select(F.col("id").alias("src"), F.col("depth").alias("a")), "src", "left").join(d.select(F.col("id").alias("dst"), F.col("depth").alias("b")), "dst", "left")
    skip = e.where((F.abs(F.col("a") - F.col("b")) > 1) | (F.col("a").isNull() != F.col("b").isNull())).agg(F.count("*").cast("long").alias("skips"))
    return tree.agg(F.count("*").cast("long").alias("reached")).join(wrong_depth, how="cross").join(no_edge, how="cross").join(skip, how="cross")  # one row each
