"""Pairs of vertices by the neighbours they share, counted where lists lie: equal to brute force, for 4-cycles and link prediction too."""

from collections import Counter
from itertools import combinations

import pytest

from quarry.operators import blocks, pattern, similarity
from tests.test_pairs import FAR_IDS, NEAR_IDS, _graph


@pytest.mark.parametrize("ids", [NEAR_IDS, FAR_IDS])
@pytest.mark.parametrize("held, work", [(150, 7), (10**6, 10**6)])
def test_pairs_by_shared_neighbours(spark, monkeypatch, ids, held, work):
    monkeypatch.setattr(blocks, "PATHS", held)
    monkeypatch.setattr(blocks, "WORK", work)
    g, half, near = _graph(spark, ids)
    lists = g.adjacency()
    shared = {(u, v): len(near[u] & near[v]) for u, v in combinations(sorted(ids), 2)}
    want = Counter((p in set(half), n) for p, n in shared.items() if n)
    assert {(r.linked, r.n): r.pairs for r in blocks.ends(lists).collect()} == want
    assert sorted((r.u, r.v, r.n) for r in blocks.ends(lists, 6).collect()) == sorted((*p, n) for p, n in shared.items() if n >= 6 and p not in set(half))
    monkeypatch.setattr(similarity, "common", None)  # a row for each path between two vertices, before
    best = sorted(((-n, p) for p, n in shared.items() if n and p not in set(half)))
    for q in (5, 10**6):
        assert [(r.u, r.v, r.score) for r in similarity.predict(g, "common_neighbours", q).orderBy("u", "v").collect()] == sorted((*p, -n) for n, p in best[:q])
    assert pattern.count(g, "cycle4", induced=False).first().occurrences == sum(n * (n - 1) // 2 for n in shared.values()) // 2
