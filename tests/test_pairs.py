"""Lists that meet in pairs of blocks: each list is sent once to a pair, however ids lie and however little a task holds or looks up at a time."""

import random
from itertools import combinations

import pytest

from quarry.operators import blocks
from quarry.operators.graph import Graph

NEAR_IDS = list(range(5, 45))
FAR_IDS = [7 * v + (10**12 if v % 5 == 0 else 0) for v in range(40)]


def _graph(spark, ids):
    half = sorted(tuple(sorted(e)) for e in random.Random(3).sample(list(combinations(ids, 2)), 300))
    half += [tuple(sorted((ids[0], v))) for v in ids[1:] if tuple(sorted((ids[0], v))) not in half]  # a hub
    near = {v: {w for e in half if v in e for w in e if w != v} for v in ids}
    return Graph.from_edges(spark.createDataFrame(half, "src long, dst long")).kept(), half, near


@pytest.mark.parametrize("ids", [NEAR_IDS, FAR_IDS])
@pytest.mark.parametrize("held, work", [(150, 7), (10**6, 10**6)])
def test_lists_meet_in_pairs_of_blocks(spark, monkeypatch, ids, held, work):
    monkeypatch.setattr(blocks, "HELD", held)
    monkeypatch.setattr(blocks, "WORK", work)
    g, half, near = _graph(spark, ids)
    lists = g.adjacency()
    want = {(u, v): sorted(near[u] & near[v]) for u, v in half}
    assert sorted((r.src, r.dst, r.both) for r in blocks.met(lists, directed=False).collect()) == sorted((*e, b) for e, b in want.items())
    assert {(r.src, r.dst): r.n for r in blocks.met(lists, directed=False, counted=True).collect()} == {e: len(b) for e, b in want.items()}
    later = lists.selectExpr("id", "filter(nbrs, x -> x > id) AS nbrs").where("size(nbrs) > 0")
    found = {(r.src, r.dst): r.both for r in blocks.met(later, directed=True).collect()}
    assert found == {(u, v): b for u, v in half if (b := [w for w in sorted(near[u] & near[v]) if w > v])}


def test_a_list_is_sent_once_to_a_pair(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 150)
    lists = _graph(spark, NEAR_IDS)[0].adjacency()
    assert blocks._paired(blocks._ranked(lists), 600).count() == 4 * lists.count()  # were 8


def test_no_lists_meet_in_nothing(spark):
    empty = spark.createDataFrame([], "id long, nbrs array<long>")
    assert blocks.met(empty, directed=False).count() == 0


def test_johansson_asks_fewer_arcs_each_round(spark, monkeypatch):
    from quarry.operators import color

    g, half, _ = _graph(spark, NEAR_IDS)
    sizes = []

    def counted(df, name, **options):
        out = materialize(df, name, **options)
        if name == "color-edges":
            sizes.append(out.count())
        return out

    materialize = color.materialize
    monkeypatch.setattr(color, "materialize", counted)
    found = {r.id: r.color for r in color.johansson(g).collect()}
    assert len(found) == 40 and all(found[u] != found[v] for u, v in half)
    assert sizes[0] == 2 * len(half) and sizes == sorted(sizes, reverse=True) and sizes[-1] == 0  # all arcs in every round before
