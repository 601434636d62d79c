"""Lists meet in blocks, colourings go in parts and AUC scores the pairs asked alone: equal to brute force, and without the steps that grew too fast."""

import random
from itertools import combinations

import pytest

from quarry.operators import blocks, cliques, color, similarity
from quarry.operators.graph import Graph

IDS = [7 * v + (10**12 if v % 5 == 0 else 0) for v in range(40)]
HALF = sorted(tuple(sorted(e)) for e in random.Random(3).sample(list(combinations(IDS, 2)), 300))
NEAR = {v: {w for e in HALF if v in e for w in e if w != v} for v in IDS}


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.from_edges(spark.createDataFrame(HALF, "src long, dst long")).kept()


def test_edges_meet_in_many_blocks(graph, monkeypatch):
    monkeypatch.setattr(blocks, "ARCS", 150)  # 600 members: 4 blocks
    lists = graph.adjacency()
    sent = blocks._sides(blocks._ranked(lists), 600)
    assert sent.count() == 2 * 4 * lists.count()  # not once to each arc
    rows = {(r.src, r.dst): sorted(r.both) for r in blocks.met(lists, directed=False).collect()}
    assert rows == {(u, v): sorted(NEAR[u] & NEAR[v]) for u, v in HALF}
    threes = {c for c in combinations(IDS, 3) if all(y in NEAR[x] for x, y in combinations(c, 2))}
    assert {tuple(sorted(r)) for r in cliques.triangles(graph).collect()} == {tuple(sorted(c)) for c in threes}
    fours = [c for c in combinations(IDS, 4) if all(y in NEAR[x] for x, y in combinations(c, 2))]
    assert cliques.clique_count(graph, 4).first().cliques == len(fours)


@pytest.mark.parametrize("tail", [60, 150])
def test_colouring_in_parts_is_greedy(graph, monkeypatch, tail):
    order = graph.vertices.selectExpr("id", "-id AS p1", "0 AS p2")
    slow = {}
    for v in sorted(IDS):
        slow[v] = min(set(range(1, 50)) - {slow[w] for w in NEAR[v] if w in slow})
    monkeypatch.setattr(color, "_in_rounds", None)  # rounds were one for each vertex on the longest path
    assert {r.id: r.color for r in color.by_priority(graph, order, tail=tail).collect()} == slow


@pytest.mark.parametrize("metric", ["common_neighbours", "adamic_adar"])
def test_auc_makes_no_other_pairs(graph, monkeypatch, metric):
    true = graph.half.limit(20).selectExpr("src AS u", "dst AS v")
    false = graph.half.sparkSession.createDataFrame([e for e in combinations(IDS, 2) if tuple(sorted(e)) not in HALF][:20], "u long, v long")
    known = {(r.u, r.v): (r.common, r.adamic) for r in similarity.common(graph).collect()}
    for r in similarity.between(true, graph, metric).collect():
        assert r.common == known.get((r.u, r.v), (0, 0))[0]
        assert metric != "adamic_adar" or abs(r.adamic - known[r.u, r.v][1]) < 1e-9
    monkeypatch.setattr(similarity, "common", None)
    assert 0 <= similarity.auc(graph, true, false, metric, 100).first().auc <= 1


@pytest.mark.parametrize("kind", ["saturation", "incidence"])
def test_dynamic_colouring_holds_little_beside_the_lists(kind):
    import tracemalloc

    import numpy as np
    import pandas as pd

    near = {v: set() for v in range(600)}
    for a, b in random.Random(5).sample(list(combinations(near, 2)), 30_000):
        near[a].add(b)
        near[b].add(a)
    frame = pd.DataFrame({"id": list(near), "nbrs": [np.array(sorted(n)) for n in near.values()]})
    tracemalloc.start()
    found = next(color._dynamic(kind)(iter([frame])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = dict(zip(found.id, found.color))
    assert len(got) == 600 and all(got[a] != got[b] for a in near for b in near[a])
    assert peak < 25 * 60_000  # bytes an arc; lists of ints and sets took 70 and 123
