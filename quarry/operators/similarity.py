"""Vertex similarity, link prediction and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import choice, h, h2
from quarry.functions.similarity import METRICS, similarity
from quarry.operators.blocks import ends, met
from quarry.operators.graph import Graph, normalise, numbered
from quarry.storage import materialize

#: Rows up to which a leading part of an order is taken by a limit.
FEW = 10_000


def common(g: Graph) -> DataFrame:
    """(u, v, common, adamic, resource) for u < v with a shared neighbour: wedges, summed by their ends.

    Partial sums keep what is shuffled near the number of pairs rather than of wedges.
    """
    d = g.degrees()
    arcs = g.edges.join(d.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("w"), F.col("dst").alias("end"), "degree")
    a, b = arcs.alias("a"), arcs.select("w", "end").alias("b")
    wedge = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.end") < F.col("b.end"))).select(F.col("a.end").alias("u"), F.col("b.end").alias("v"), "degree")
    return wedge.groupBy("u", "v").agg(F.count("*").alias("common"), F.sum(1.0 / F.log(F.col("degree").cast("double"))).alias("adamic"), F.sum(1.0 / F.col("degree")).alias("resource"))


def scored(pairs: DataFrame, g: Graph, metrics: list[str]) -> DataFrame:
    """pairs(u, v, common, adamic, resource) with a column for each metric."""
    d = g.degrees()
    rows = pairs.join(d.select(F.col("id").alias("u"), F.col("degree").alias("da")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("db")), "v")
    return rows.select("u", "v", *[similarity(m, F.col("common"), F.col("da"), F.col("db"), F.col("adamic"), F.col("resource")).alias(m) for m in metrics])


def _weighed(rows: DataFrame, g: Graph, weighted: bool) -> DataFrame:
    """(u, v, common, adamic, resource) of rows(u, v, both); the two sums are made only if weighted."""
    if not weighted:
        return rows.select("u", "v", F.size("both").cast("long").alias("common"), F.lit(0.0).alias("adamic"), F.lit(0.0).alias("resource"))
    d = g.degrees().withColumnRenamed("id", "w")
    each = rows.select("u", "v", F.explode("both").alias("w")).join(d, "w")
    return each.groupBy("u", "v").agg(F.count("*").alias("common"), F.sum(1.0 / F.log(F.col("degree").cast("double"))).alias("adamic"), F.sum(1.0 / F.col("degree")).alias("resource"))


def between(pairs: DataFrame, g: Graph, metric: str) -> DataFrame:
    """The columns of common() for the pairs(u, v) given alone: one of the two lists travels with each pair."""
    lists = materialize(g.adjacency(), "adjacency")
    rows = pairs.select("u", "v").distinct().join(lists.select(F.col("id").alias("u"), F.col("nbrs").alias("a")), "u").join(lists.select(F.col("id").alias("v"), F.col("nbrs").alias("b")), "v")
    return _weighed(rows.select("u", "v", F.array_intersect("a", "b").alias("both")), g, metric in ("adamic_adar", "resource_allocation"))


def edge_similarity(g: Graph, metrics: list[str] = METRICS) -> DataFrame:
    """(u, v, the metrics) of every edge u < v; sums over no shared neighbour are 0."""
    e = g.half.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    both = met(materialize(g.adjacency(), "adjacency"), directed=False).select(F.col("src").alias("u"), F.col("dst").alias("v"), "both")
    rows = e.join(_weighed(both, g, True), ["u", "v"], "left").select("u", "v", F.coalesce("common", F.lit(0)).alias("common"), F.coalesce("adamic", F.lit(0.0)).alias("adamic"), F.coalesce("resource", F.lit(0.0)).alias("resource"))
    return scored(rows, g, metrics)


def predict(g: Graph, metric: str, q: int) -> DataFrame:
    """The q non-edges u < v of the highest score, ties to the smallest (u, v).

    Metrics that are 0 without a shared neighbour need only pairs with one. The other two are largest among vertices of high degree: the search takes the K highest and doubles K until no pair outside can reach the q-th score.
    """
    e = g.half.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if metric in ("total_neighbours", "preferential_attachment"):
        return _predict_by_degree(g, metric, q)
    if metric == "common_neighbours":
        rows = _most_common(g, q).select("u", "v", F.col("n").cast("double").alias("score"))
        return _leading(rows, [F.desc("score"), F.col("u"), F.col("v")], q).drop("place") if q > FEW else rows.orderBy(F.desc("score"), "u", "v").limit(q)
    rows = scored(common(g), g, [metric]).join(e, ["u", "v"], "left_anti")
    rows = rows.select("u", "v", F.col(metric).alias("score"))
    return _leading(rows, [F.desc("score"), F.col("u"), F.col("v")], q).drop("place") if q > FEW else rows.orderBy(F.desc("score"), "u", "v").limit(q)


def _most_common(g: Graph, q: int) -> DataFrame:
    """(u, v, n) of the non-edges with the most shared neighbours: as many as q at least, if there are, with all that tie.

    How many pairs share how many is counted first, so that none but these leave their tasks.
    """
    lists = materialize(g.adjacency(), "adjacency")
    least, pairs = 1, 0
    for r in ends(lists).where("not linked").orderBy(F.desc("n")).collect():  # a row for each number shared
        least, pairs = r.n, pairs + r.pairs
        if pairs >= q:
            break
    return materialize(ends(lists, least), "most-common")


def _leading(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of an order, with their `place`; more than a few are numbered by partitions, as one task can't hold them."""
    few = rows.orderBy(*order).limit(n) if n <= FEW else rows
    return numbered(few, order, "place").where(F.col("place") < n)


def _predict_by_degree(g: Graph, metric: str, q: int) -> DataFrame:
    ranked = materialize(numbered(g.degrees(), [F.col("degree").desc(), F.col("id")], "place"), "by-degree")
    n, k = ranked.count(), max(16, int((2 * q) ** 0.5) + 8)
    shared, known = common(g), g.half.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    while True:
        top = ranked.where(F.col("place") < k)
        # all pairs of k rows, by an equi-join on places
        a = top.select(F.col("id").alias("x"), F.col("degree").alias("dx"), F.explode(F.sequence(F.col("place") + 1, F.lit(max(k, 1)))).alias("place"))
        pairs = a.join(top.select(F.col("id").alias("y"), F.col("degree").alias("dy"), "place"), "place")
        pairs = pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).join(known, ["u", "v"], "left_anti")
        pairs = pairs.join(shared, ["u", "v"], "left").select("u", "v", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("common", "adamic", "resource")])
        best = materialize(scored(pairs, g, [metric]).select("u", "v", F.col(metric).alias("score")).orderBy(F.desc("score"), "u", "v").limit(q), "predicted")
        if k >= n:
            return best
        last = best.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        edge = ranked.where(F.col("place").isin(0, k)).agg(F.max("degree").alias("hi"), F.min("degree").alias("lo")).first()
        outside = edge.hi + edge.lo if metric == "total_neighbours" else edge.hi * edge.lo
        if last.n == q and last.s > outside:
            return best
        k = min(2 * k, n)


# --- evaluation ------------------------------------------------------------------------------


def sample_edges(g: Graph, n: int, seed: int = 0) -> DataFrame:
    """(u, v, place): n edges chosen by hash, all equally likely."""
    e = g.half.select(F.col("src").alias("u"), F.col("dst").alias("v")).withColumn("k", h2(F.col("u"), F.col("v"), seed))
    return _leading(e, ["k", "u", "v"], n).select("u", "v", "place")


def sample_non_edges(g: Graph, n: int, top: int, seed: int = 0, tries: int = 4) -> DataFrame:
    """(u, v, place): up to n pairs of ids up to `top` that are no edges, from hashed trials in order."""
    spark = g.half.sparkSession
    i = F.col("id")
    rows = spark.range(0, n * tries).select("id", (choice(h(i, seed + 1), top) + 1).alias("x"), (choice(h2(i, i, seed + 2), top) + 1).alias("y"))
    rows = rows.where("x <> y").select("id", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).groupBy("u", "v").agg(F.min("id").alias("id"))
    rows = rows.join(g.half.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")
    return _leading(rows, ["id"], n).select("u", "v", "place")


def split(g: Graph, rate: float, seed: int = 0) -> tuple[Graph, DataFrame]:
    """(training graph, test edges): floor(rate * m) edges chosen by hash are taken out."""
    n = int(rate * g.half.count())
    test = materialize(sample_edges(g, n, seed).select("u", "v"), "test-edges")
    train = remove_edges(g, test)
    return train, test


def add_edges(g: Graph, pairs: DataFrame) -> Graph:
    return Graph(normalise(g.half.unionByName(pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")))), g.given)


def remove_edges(g: Graph, pairs: DataFrame) -> Graph:
    gone = normalise(pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    return Graph(g.half.join(gone, ["src", "dst"], "left_anti"), g.given)


def noisy(g: Graph, n: int, top: int, seed: int = 0) -> Graph:
    """n edges taken out by hash and n hashed non-edges put in."""
    out = sample_edges(g, n, seed).select("u", "v")
    put = sample_non_edges(g, n, top, seed + 10).select("u", "v")
    return add_edges(remove_edges(g, out), put)


def precision_recall(predicted: DataFrame, true: DataFrame) -> DataFrame:
    hits = predicted.join(true, ["u", "v"], "left_semi").agg(F.count("*").alias("hits"))
    sizes = predicted.agg(F.count("*").alias("predicted")).join(true.agg(F.count("*").alias("true")), how="cross").join(hits, how="cross")  # one row each
    return sizes.select("hits", "predicted", "true", F.round(F.try_divide("hits", "predicted"), 6).alias("precision"), F.round(F.try_divide("hits", "true"), 6).alias("recall"))


def auc(g: Graph, true: DataFrame, false: DataFrame, metric: str, samples: int) -> DataFrame:
    """Share of samples in which the true pair scores higher, half for equal; sample i pairs hashed places of both tables."""
    shared = materialize(between(true.select("u", "v").unionByName(false.select("u", "v")), g, metric), "common")

    def scores(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(shared, ["u", "v"], "left").select("u", "v", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("common", "adamic", "resource")])
        d = g.degrees()
        rows = rows.join(d.select(F.col("id").alias("u"), F.col("degree").alias("da")), "u", "left").join(d.select(F.col("id").alias("v"), F.col("degree").alias("db")), "v", "left").na.fill(0, ["da", "db"])
        score = similarity(metric, F.col("common"), F.col("da"), F.col("db"), F.col("adamic"), F.col("resource"))
        return numbered(rows.select("u", "v", F.coalesce(score, F.lit(0.0)).alias("score")), ["u", "v"], "place")

    t, f = materialize(scores(true), "true-scores"), materialize(scores(false), "false-scores")
    nt, nf = t.count(), f.count()
    if not nt or not nf:
        return t.agg(F.lit(None).cast("double").alias("auc"))
    i = F.col("id")
    picks = g.half.sparkSession.range(0, samples).select(choice(h(i, 21), nt).alias("a"), choice(h2(i, i, 22), nf).alias("b"))
    rows = picks.join(t.select(F.col("place").alias("a"), F.round("score", 9).alias("s")), "a").join(f.select(F.col("place").alias("b"), F.round("score", 9).alias("r")), "b")
    return rows.agg(F.round((F.count(F.when(F.col("s") > F.col("r"), 1)) + 0.5 * F.count(F.when(F.col("s") == F.col("r"), 1))) / F.count("*"), 6).alias("auc"))
