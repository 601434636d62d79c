"""Embeddings of a small pattern graph in a target graph, one join per pattern vertex."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import cliques
from quarry.operators.blocks import ends
from quarry.operators.graph import Graph
from quarry.operators.rooted import Around, around
from quarry.storage import materialize

# Named patterns as edge lists.
PATTERNS = {
    "triangle": [(0, 1), (1, 2), (0, 2)],
    "path3": [(0, 1), (1, 2)],
    "star3": [(0, 1), (0, 2), (0, 3)],
    "cycle4": [(0, 1), (1, 2), (2, 3), (0, 3)],
    "diamond": [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)],
    "clique4": [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)],
    "path4": [(0, 1), (1, 2), (2, 3)],
    "tailed_triangle": [(0, 1), (1, 2), (0, 2), (2, 3)],
}


def join_order(edges: list[tuple[int, int]]) -> list[int]:
    """Pattern vertices so that each after the first has an earlier neighbour; most connected first."""
    nbr: dict[int, set[int]] = {}
    for a, b in edges:
        nbr.setdefault(a, set()).add(b)
        nbr.setdefault(b, set()).add(a)
    order = [max(nbr, key=lambda v: (len(nbr[v]), -v))]
    while len(order) < len(nbr):
        rest = [v for v in nbr if v not in order]
        best = max(rest, key=lambda v: (len(nbr[v] & set(order)), len(nbr[v]), -v))
        if not nbr[best] & set(order):
            raise ValueError("the pattern must be connected")
        order.append(best)
    return order


def embeddings(g: Graph, edges: list[tuple[int, int]], induced: bool = True) -> DataFrame:
    """Columns p0, p1, ...: target vertices of every embedding (ordered, so automorphisms count).

    A pattern edge to an earlier vertex extends or filters by join, a missing edge filters by anti-join if induced, and target vertices need at least the pattern vertex's degree.
    """
    order = join_order(edges)
    linked = {frozenset(e) for e in edges}
    need = {v: sum(v in e for e in linked) for v in order}
    arcs = g.edges
    degree = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def able(v: int) -> DataFrame:
        return degree.where(F.col("degree") >= need[v]).select(F.col("id").alias(f"p{v}"))

    rows = able(order[0])
    for i, v in enumerate(order[1:], 1):
        before = order[:i]
        near = [u for u in before if frozenset((u, v)) in linked]
        step = arcs.select(F.col("src").alias(f"p{near[0]}"), F.col("dst").alias(f"p{v}"))
        if need[v] > 1:
            step = step.join(able(v), f"p{v}", "left_semi")
        rows = rows.join(step, f"p{near[0]}")
        for u in before:
            if u != near[0]:
                rows = rows.where(F.col(f"p{u}") != F.col(f"p{v}"))
        for u in near[1:]:
            rows = rows.join(arcs.select(F.col("src").alias(f"p{u}"), F.col("dst").alias(f"p{v}")), [f"p{u}", f"p{v}"], "left_semi")
        if induced:
            for u in before:
                if frozenset((u, v)) not in linked:
                    rows = rows.join(arcs.select(F.col("src").alias(f"p{u}"), F.col("dst").alias(f"p{v}")), [f"p{u}", f"p{v}"], "left_anti")
    return rows.select(*[f"p{v}" for v in sorted(order)])


def automorphisms(edges: list[tuple[int, int]]) -> int:
    from itertools import permutations

    linked = {frozenset(e) for e in edges}
    names = sorted({v for e in edges for v in e})
    count = 0
    for p in permutations(names):
        to = dict(zip(names, p))
        count += {frozenset(to[v] for v in e) for e in linked} == linked
    return count


#: Occurrences of a pattern as a sum of the subgraph counts below, each times its factor: of any, then of induced ones.
#: An induced count takes away what denser patterns on the same vertices hold of it.
ANY = {"triangle": {"triangles": 1}, "path3": {"paths": 1}, "cycle4": {"cycles": 1}, "diamond": {"diamonds": 1}, "clique4": {"cliques": 1}, "tailed_triangle": {"tails": 1}}
INDUCED = ANY | {
    "path3": {"paths": 1, "triangles": -3},
    "cycle4": {"cycles": 1, "diamonds": -1, "cliques": 3},
    "diamond": {"diamonds": 1, "cliques": -6},
    "tailed_triangle": {"tails": 1, "diamonds": -4, "cliques": 12},
}


def _choose_two(x: str) -> Column:
    return F.coalesce(F.sum(F.expr(f"{x} * ({x} - 1) div 2")), F.lit(0)).cast("long")


def _cycles(g: Graph) -> DataFrame:
    """4-cycles: any two of the neighbours that two vertices share make one, and it is found at both pairs of opposite corners."""
    rows = ends(materialize(g.adjacency(), "adjacency"))
    return rows.agg(F.coalesce(F.expr("sum(pairs * (n * (n - 1) div 2)) div 2"), F.lit(0)).cast("long").alias("cycles"))


def _diamonds(g: Graph, fours: bool) -> DataFrame:
    """Edges with two triangles on them, at their first vertices by degree, and, if fours, 4-cliques, found there too."""
    count = cliques._count_rooted(4)

    def run(roots: Around) -> Iterator[pa.RecordBatch]:
        n = roots.shared()
        yield pa.RecordBatch.from_arrays([pa.array([int((n * (n - 1) // 2).sum())], pa.int64()), next(count(roots)).column(0) if fours else pa.array([0], pa.int64())], ["diamonds", "cliques"])

    rows = around(cliques._later(g), run, "diamonds long, cliques long", earlier=True)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("diamonds", *(["cliques"] if fours else []))])


def subgraphs(g: Graph, wanted: set[str]) -> DataFrame:
    """One row with the counts wanted: paths of 3, triangles, 4-cycles, edges with two triangles on them (diamonds), triangles with a tail, 4-cliques."""
    parts = []
    if "triangles" in wanted:
        parts.append(cliques.triangle_total(g))
    if "paths" in wanted:
        parts.append(g.degrees().agg(_choose_two("degree").alias("paths")))
    if "cycles" in wanted:
        parts.append(_cycles(g))
    if "diamonds" in wanted:
        parts.append(_diamonds(g, "cliques" in wanted))
    if "tails" in wanted:
        ends = cliques.vertex_triangles(g).select("id", F.col("tri").alias("n"))
        parts.append(ends.join(g.degrees(), "id").agg(F.coalesce(F.sum(F.col("n") * (F.col("degree") - 2)), F.lit(0)).cast("long").alias("tails")))
    if "cliques" in wanted and "diamonds" not in wanted:
        parts.append(cliques.clique_count(g, 4).select("cliques"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, how="cross")  # one row each
    return out


def count(g: Graph, name: str, induced: bool = True) -> DataFrame:
    """One row: embeddings, and occurrences (embeddings over automorphisms).

    Patterns of up to four vertices are counted from triangles, cliques and wedges without making an embedding; the others are enumerated.
    """
    edges = PATTERNS[name]
    same, terms = automorphisms(edges), (INDUCED if induced else ANY).get(name)
    if terms:
        total = sum((F.col(t) * k for t, k in terms.items()), F.lit(0))
        rows = subgraphs(g, set(terms)).select((total * same).cast("long").alias("embeddings"))
    else:
        rows = embeddings(g, edges, induced).agg(F.count("*").cast("long").alias("embeddings"))
    return rows.select(F.lit(name).alias("pattern"), F.lit(induced).alias("induced"), "embeddings", F.expr(f"embeddings div {same}").alias("occurrences"))


def first(g: Graph, edges: list[tuple[int, int]], induced: bool = True) -> DataFrame:
    """At most one embedding; Spark stops when it is found."""
    return embeddings(g, edges, induced).limit(1)


def check(g: Graph, found: DataFrame, edges: list[tuple[int, int]], induced: bool = True) -> DataFrame:
    """(found, wrong): embeddings, and pairs of them that break the pattern."""
    names = sorted({v for e in edges for v in e})
    linked = {frozenset(e) for e in edges}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if induced or frozenset((a, b)) in linked]
    asked = found.select(F.explode(F.array(*[F.struct(F.col(f"p{a}").alias("u"), F.col(f"p{b}").alias("v"), F.lit(frozenset((a, b)) in linked).alias("want")) for a, b in pairs])).alias("x")).select("x.*")
    got = g.connected(asked.select("u", "v").distinct())
    wrong = asked.join(got, ["u", "v"]).where(F.col("want") != F.col("connected")).agg(F.count("*").cast("long").alias("wrong"))
    return found.agg(F.count("*").cast("long").alias("found")).join(wrong, how="cross")  # one row each
