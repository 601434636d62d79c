import pytest

from quarry.operators import cliques, color, order, pattern, traverse
from quarry.operators.graph import Graph, is_directed
from tests.graphs import CLIQUES, COUNTS, EDGES, ORDERS, TRIANGLES, graph


def numbers(text):
    return [int(x) for x in text.split()]


def by_id(df, column):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r.id)]


@pytest.mark.parametrize("name", COUNTS)
def test_counts(spark, name):
    n, m, triangles, four, five, maximal, degeneracy, comps = COUNTS[name]
    g = graph(spark, name)
    stats = g.stats().first()
    assert (stats.n, stats.m) == (n, m)
    assert cliques.triangle_total(g).first().triangles == triangles == cliques.triangle_total_by_join(g).first().triangles
    assert [cliques.clique_count(g, k).first().cliques for k in (1, 2, 3, 4, 5)] == [n, m, triangles, four, five]
    assert cliques.clique_count(g, 4, seed="vertex").first().ordered == 24 * four
    assert cliques.maximal_cliques(g).count() == maximal
    assert max(by_id(order.core_numbers(g), "core")) == degeneracy
    assert traverse.component_sizes(traverse.components(g)).count() == comps


@pytest.mark.parametrize("name", TRIANGLES)
def test_vertex_triangles(spark, name):
    assert by_id(cliques.vertex_triangles(graph(spark, name)), "tri") == numbers(TRIANGLES[name])


@pytest.mark.parametrize("name", CLIQUES)
def test_maximal_cliques(spark, name):
    g = graph(spark, name)
    want = sorted([int(v) for v in c.split(",")] for c in CLIQUES[name].split())
    assert sorted(r.clique for r in cliques.maximal_cliques(g).collect()) == want
    assert sorted(r.clique for r in cliques.maximal_cliques_by_level(g).collect()) == want
    assert sorted(r.clique for r in cliques.maximal_cliques(g, order.degeneracy(g)).collect()) == want
    check = cliques.clique_check(g, cliques.maximal_cliques(g)).first()
    assert (check.cliques, check.not_cliques, check.not_maximal, check.repeated) == (len(want), 0, 0, 0)


@pytest.mark.parametrize("name", ORDERS)
def test_orders_cores_and_greedy_colors(spark, name):
    smallest, cores, approximate, width, up, down = ORDERS[name]
    g = graph(spark, name)
    sequence = lambda ranks: [r.id for r in sorted(ranks.collect(), key=lambda r: r["rank"])]
    assert sequence(order.degeneracy(g)) == numbers(smallest)
    assert sequence(order.degeneracy_reversed(g)) == numbers(smallest)[::-1]
    assert by_id(order.core_numbers(g), "core") == numbers(cores)
    ranks = order.approximate(g)
    assert sequence(ranks) == numbers(approximate) and order.width(g, ranks).first().width == width
    assert by_id(color.greedy(g), "color") == numbers(up) and by_id(color.greedy(g, descending=True), "color") == numbers(down)


@pytest.mark.parametrize("scheme", [color.johansson, color.barenboim, color.elkin, color.dense_sparse, color.jones_plassmann, color.dynamic])
def test_colorings_are_proper(spark, scheme):
    for name in ("kc4b", "three_triangles"):
        g = graph(spark, name)
        row = color.valid(g, scheme(g)).first()
        assert (row.n, row.uncolored, row.conflicts, row.within_max_degree) == (COUNTS[name][0], 0, 0, True)


def test_pattern_counts_and_automorphisms(spark):
    from itertools import permutations

    g = graph(spark, "nine_vertices")
    linked = {frozenset(map(int, e.split("-"))) for e in EDGES["nine_vertices"].split()}
    for name in ("path3", "cycle4", "diamond", "star3"):
        edges = pattern.PATTERNS[name]
        k = 1 + max(v for e in edges for v in e)
        for induced in (True, False):
            want = 0
            for t in permutations(range(9), k):
                inside = {frozenset((i, j)) for i in range(k) for j in range(i) if frozenset((t[i], t[j])) in linked}
                asked = {frozenset(e) for e in edges}
                want += inside == asked if induced else asked <= inside
            row = pattern.count(g, name, induced).first()
            assert (row.embeddings, row.occurrences) == (want, want // pattern.automorphisms(edges))
    one = pattern.first(g, pattern.PATTERNS["cycle4"])
    assert pattern.check(g, one, pattern.PATTERNS["cycle4"]).first().asDict() == {"found": 1, "wrong": 0}


def test_stars(spark):
    g = graph(spark, "kc4a")
    stars = {tuple(r.clique): r.star for r in cliques.clique_stars(g).collect()}
    assert len(stars) == 14 and stars[0, 1, 2] == [3, 4] and stars[2, 5, 6] == [1]


def test_pagerank_and_betweenness(spark):
    g = graph(spark, "path3")
    ranks = by_id(traverse.pagerank(g.edges, 100, tolerance=1e-12), "rank")
    assert ranks[1] == pytest.approx(0.486486, abs=1e-5) and sum(ranks) == pytest.approx(1)
    assert by_id(traverse.betweenness(g, [0]), "score") == [0, 1, 0]
    assert by_id(traverse.betweenness(graph(spark, "tree6"), list(range(6))), "score") == pytest.approx([1, 0.444444, 0, 0, 0, 0], abs=1e-5)


def test_shortest_paths_against_dijkstra(spark):
    import heapq

    g = graph(spark, "nine_vertices")
    weights = [(r.src, r.dst, 1 + (r.src * r.dst) % 7) for r in g.edges.collect()]
    dist, heap = {}, [(0, 0)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in dist:
            continue
        dist[v] = d
        heap += [(d + w, b) for a, b, w in weights if a == v]
        heapq.heapify(heap)
    assert {r.id: r.dist for r in traverse.sssp(spark.createDataFrame(weights, "src long, dst long, weight long"), 0).collect()} == dist


def test_empty_and_unnormalised_graphs(spark):
    empty = Graph.from_edges(spark.createDataFrame([(1, 1)], "src long, dst long"))
    assert cliques.triangle_total(empty).first().triangles == 0 and cliques.maximal_cliques(empty).count() == 0
    raw = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 2)], "src long, dst long")
    assert [tuple(r) for r in Graph.from_edges(raw).half.collect()] == [(1, 2)]
    assert Graph.from_edges(raw, normalised=True).half.count() == 4
    assert is_directed(raw).first().directed is False and is_directed(raw.where("src < dst")).first().directed is True
    g = Graph.from_edges(spark.createDataFrame([(0, 2)], "src long, dst long"), spark.range(3).select("id"))
    assert by_id(g.degrees(), "degree") == [1, 0, 1] and by_id(g.without_isolated(), "new_id") == [0, 1]
