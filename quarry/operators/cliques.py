"""Triangles, k-cliques, k-clique-stars and maximal cliques over array adjacency."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.blocks import met
from quarry.operators.graph import Graph
from quarry.operators.rooted import OUT, Around, around, upward, vertex_counts
from quarry.storage import materialize


def _out(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def _later(g: Graph, ranks: DataFrame | None = None) -> DataFrame:
    """(id, nbrs): neighbours of higher (degree, id), or of higher rank: out-neighbourhoods are small even at hubs."""
    g = g.listed()
    lists = upward(g.near, g.near.select("id", F.size("nbrs").alias("place")) if ranks is None else ranks.select("id", F.col("rank").alias("place")))
    return materialize(_out(g.by_degree() if ranks is None else g.orient(ranks)) if lists is None else lists, "out-lists")


# --- triangles ---------------------------------------------------------------------------------


def triangle_total(g: Graph) -> DataFrame:
    """Each triangle once: arcs go to the end of higher degree, and both out-neighbourhoods of an arc meet."""
    rows = met(_later(g), directed=True, counted=True)
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def triangle_total_by_join(g: Graph) -> DataFrame:
    """The same count over u < v < w by id, for comparison: larger neighbours of both ends of an edge, met in blocks, as a row for each wedge is too much."""
    rows = met(materialize(upward(g.listed().near, None), "out-lists"), directed=True, counted=True)
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def triangles(g: Graph) -> DataFrame:
    """(a, b, c): every triangle once."""
    rows = met(_later(g), directed=True).select("src", "dst", F.explode("both").alias("third"))
    t = F.array_sort(F.array("src", "dst", "third"))
    return rows.select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def vertex_triangles(g: Graph) -> DataFrame:
    """(id, tri2, tri): twice the triangles of a vertex, and the triangles; each found once and given to its three ends in the task that finds it."""
    g = g.listed()
    rows = vertex_counts(_later(g)).withColumnRenamed("n", "tri")
    return g.vertices.join(rows, "id", "left").select("id", (2 * F.coalesce("tri", F.lit(0))).cast("long").alias("tri2"), F.coalesce("tri", F.lit(0)).cast("long").alias("tri"))


# --- k-cliques ---------------------------------------------------------------------------------


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _above(v: int) -> int:
    """The mask of all places after v."""
    return -1 << (v + 1)


def _chains(nbr: list[int], later: int, size: int) -> Iterator[tuple[list[int], int]]:
    """(places, shared): chains of `size` of the first `later` places, each after the one before and a neighbour of all, and the mask of what all share."""
    stack = [([v], nbr[v]) for v in range(later)]
    among = (1 << later) - 1
    while stack:
        chain, shared = stack.pop()
        if len(chain) == size:
            yield chain, shared
            continue
        stack += [([*chain, v], shared & nbr[v]) for v in _bits(shared & among & _above(chain[-1]))]


def _arrays(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of lists of ids as batches of about OUT members."""

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64())) for c in zip(*held)], names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row))
        if size > OUT:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _count_rooted(k: int):
    def run(roots: Around) -> Iterator[pa.RecordBatch]:
        n = 0
        for _, _, later, nbr, _ in roots:
            among = (1 << later) - 1
            n += sum((shared & among & _above(chain[-1])).bit_count() for chain, shared in _chains(nbr, later, k - 2))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def _list_rooted(k: int):
    def cliques(roots: Around) -> Iterator[tuple]:
        for root, names, later, nbr, _ in roots:
            for chain, shared in _chains(nbr, later, k - 2):
                for w in _bits(shared & (1 << later) - 1 & _above(chain[-1])):
                    yield (sorted([root, *(names[v] for v in chain), names[w]]),)

    return lambda roots: _arrays(cliques(roots), ["clique"])


def clique_count(g: Graph, k: int, arcs: DataFrame | None = None, seed: str = "edge") -> DataFrame:
    """cliques, and ordered = cliques * k!; the last level is counted, not made. Any acyclic orientation serves.

    A clique is counted at its first vertex, from the arcs among that vertex's out-neighbours; so are triangles if the seed is "vertex", which are counted at their arcs otherwise.
    """
    if k == 1:
        rows = g.vertices.agg(F.count("*").cast("long").alias("cliques"))
    elif k == 2:
        rows = g.half.agg(F.count("*").cast("long").alias("cliques"))
    else:
        lists = _later(g) if arcs is None else materialize(_out(arcs), "out-lists")
        rows = met(lists, directed=True, counted=True) if k == 3 and seed == "edge" else around(lists, _count_rooted(k), "n long")
        rows = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cliques"))
    return rows.select(F.lit(k).alias("k"), "cliques", (F.col("cliques") * math.factorial(k)).cast("long").alias("ordered"))


def clique_list(g: Graph, k: int) -> DataFrame:
    """(clique): sorted vertex arrays."""
    if k == 1:
        return g.vertices.select(F.array("id").alias("clique"))
    if k == 2:
        return g.half.select(F.array("src", "dst").alias("clique"))
    return around(_later(g), _list_rooted(k), "clique array<bigint>")


def _star_rows(k: int):
    def stars(roots: Around) -> Iterator[tuple]:
        for root, names, later, nbr, _ in roots:
            for chain, shared in _chains(nbr, later, k - 1):
                yield sorted([root, *(names[v] for v in chain)]), sorted(names[v] for v in _bits(shared))

    return lambda roots: _arrays(stars(roots), ["clique", "star"])


def clique_stars(g: Graph, k: int = 3) -> DataFrame:
    """(clique, star): every k-clique with all vertices adjacent to each of its members; the star may be empty.

    A clique is made at its vertex of lowest (degree, id): what all members share is what that shares with each of the others.
    """
    if k == 1:
        return g.listed().adjacency().select(F.array("id").alias("clique"), F.col("nbrs").alias("star"))
    return around(_later(g), _star_rows(k), "clique array<bigint>, star array<bigint>", earlier=True, own=k == 2)


def merge_stars(stars: DataFrame) -> DataFrame:
    """One row per clique: stars of equal cliques united."""
    return stars.groupBy("clique").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("star")))).alias("star"))


def star_check(g: Graph, stars: DataFrame) -> DataFrame:
    """Stars, and pairs of a clique's member and a star's vertex that are not adjacent."""
    pairs = stars.select(F.explode("clique").alias("u"), "star").select("u", F.explode("star").alias("v"))
    bad = g.connected(pairs).where(~F.col("connected")).agg(F.count("*").alias("bad"))
    return stars.agg(F.count("*").cast("long").alias("stars"), F.sum(F.size("star")).cast("long").alias("rays")).join(F.broadcast(bad), how="cross")  # one row each


# --- maximal cliques ---------------------------------------------------------------------------


def _alone(g: Graph) -> DataFrame | None:
    return None if g.given is None else g.given.join(g.near.select("id"), "id", "left_anti").select(F.array("id").alias("clique"))


def _level_rows(roots: Around) -> Iterator[tuple]:
    for root, names, later, nbr, _ in roots:
        among = (1 << later) - 1
        level = [([v], nbr[v]) for v in range(later)]
        while level:
            for chain, cand in level:
                if not cand:
                    yield (sorted([root, *(names[v] for v in chain)]),)
            level = [([*chain, v], cand & nbr[v]) for chain, cand in level for v in _bits(cand & among & _above(chain[-1]))]


def maximal_cliques_by_level(g: Graph) -> DataFrame:
    """(clique): level by level from a clique's vertex of lowest (degree, id), without pivot: cand are the common neighbours, and later ones of them extend.

    A level of all cliques with one root is made at once, from what the root shares with each later neighbour.
    """
    g = g.listed()
    found = around(_later(g), lambda roots: _arrays(_level_rows(roots), ["clique"]), "clique array<bigint>", earlier=True, own=True)
    return found if g.given is None else found.unionByName(_alone(g))


def expand(root: int, names: list[int], nbr: list[int], cand: int, fini: int) -> Iterator[list[int]]:
    """Maximal cliques with the root: sets are bit masks over its neighbours, the pivot covers the most candidates."""
    stack = [([root], cand, fini)]
    while stack:
        clique, p, x = stack.pop()
        if not p and not x:
            yield sorted(clique)
            continue
        if not p:
            continue
        pivot = max(_bits(p | x), key=lambda u: ((p & nbr[u]).bit_count(), -u))
        for v in _bits(p & ~nbr[pivot]):
            stack.append(([*clique, names[v]], p & nbr[v], x & nbr[v]))
            p &= ~(1 << v)
            x |= 1 << v


def _root_cliques(roots: Around) -> Iterator[tuple]:
    for root, names, later, nbr, _ in roots:
        cand = (1 << later) - 1
        for clique in expand(root, names, nbr, cand, (1 << len(names)) - 1 - cand):
            yield (clique,)


def maximal_cliques(g: Graph, ranks: DataFrame | None = None) -> DataFrame:
    """(clique): from each root in a vertex order (by degree unless given), with its neighbourhood's subgraph.

    A root's candidates are its later neighbours, so roots at hubs have few; earlier ones only rule out what is not maximal,
    and what they share with one another is not needed.
    """
    g = g.listed()
    found = around(_later(g, ranks), lambda roots: _arrays(_root_cliques(roots), ["clique"]), "clique array<bigint>", earlier=True, own=True)
    return found if g.given is None else found.unionByName(_alone(g))


def _checked(roots: Around) -> Iterator[pa.RecordBatch]:
    counts = [0, 0, 0, 0]
    for root, names, later, nbr, cliques in roots:
        place = {v: i for i, v in enumerate(names[:later])}
        for clique in cliques:
            others = [v for v in clique if v != root]
            at = [place[v] for v in others if v in place]
            known = len(at) == len(others)
            counts[0] += 1
            counts[1] += not known or any(not nbr[v] >> w & 1 for v in at for w in at if w != v)
            shared = -1
            for v in at:
                shared &= nbr[v]
            counts[2] += bool(known and others and shared)
        counts[3] += len(cliques) - len({tuple(c) for c in cliques})
    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in counts], ["cliques", "not_cliques", "not_maximal", "repeated"])


def clique_check(g: Graph, cliques: DataFrame) -> DataFrame:
    """Rows that are no clique, are not maximal, or repeat: zero each for a right result.

    A clique is checked at its smallest vertex, by what that shares with each of its larger neighbours.
    """
    g = g.listed()
    found = materialize(cliques, "cliques")
    out = materialize(upward(g.near, None), "out-lists")
    names = ["cliques", "not_cliques", "not_maximal", "repeated"]
    one = around(out, _checked, ", ".join(f"{c} long" for c in names), earlier=True, own=True, given=found.select(F.col("clique").alias("row")))
    single = found.where(F.size("clique") == 1).select(F.get("clique", F.lit(0)).alias("only")).join(g.near.select(F.col("id").alias("only")), "only", "left_semi").agg(F.count("*").alias("single"))
    sums = one.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names]).join(single, how="cross")  # one row each
    return sums.select("cliques", "not_cliques", (F.col("not_maximal") + F.col("single")).alias("not_maximal"), "repeated")
