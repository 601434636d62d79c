"""What lies around a vertex is sent as packed arrays: equal to brute force, in many blocks and partitions, and without a row for an edge."""

import random
from itertools import combinations

import pytest

from quarry.operators import blocks, cliques, pattern, rooted
from quarry.operators.graph import Graph

CLOSE = list(range(-3, 37))
FAR = [7 * v + (10**12 if v % 5 == 0 else 0) for v in range(40)]


def made(spark, ids):
    half = sorted(tuple(sorted(e)) for e in random.Random(3).sample(list(combinations(ids, 2)), 300))
    near = {v: {w for e in half if v in e for w in e if w != v} for v in ids}
    return Graph.from_edges(spark.createDataFrame(half, "src long, dst long")), near


@pytest.fixture(params=["one", "many"])
def cut(request, monkeypatch):
    if request.param == "many":
        for where, name, value in ((blocks, "HELD", 110), (blocks, "WORK", 40), (rooted, "ARCS", 100), (rooted, "MADE", 60), (rooted, "PAIRS", 200), (rooted, "OUT", 20)):
            monkeypatch.setattr(where, name, value)


@pytest.mark.parametrize("ids", [CLOSE, FAR], ids=["close", "far"])
def test_cliques_stars_and_patterns(spark, cut, ids):
    g, near = made(spark, ids)
    whole = lambda c: all(y in near[x] for x, y in combinations(c, 2))
    cl = {k: [c for c in combinations(ids, k) if whole(c)] for k in (2, 3, 4)}
    for k in (2, 3):
        want = sorted((sorted(c), sorted(set.intersection(*[near[v] for v in c]))) for c in cl[k])
        assert sorted((r.clique, r.star) for r in cliques.clique_stars(g, k).collect()) == want
    best = sorted(r.clique for r in cliques.maximal_cliques(g).collect())
    assert all(whole(c) and not set.intersection(*[near[v] for v in c]) for c in best)
    for c in cl[3]:
        assert any(set(c) <= set(b) for b in best)
    assert sorted(r.clique for r in cliques.maximal_cliques_by_level(g).collect()) == best
    ranks = g.vertices.selectExpr("id", "-id AS rank")
    found = cliques.maximal_cliques(g, ranks)
    assert sorted(r.clique for r in found.collect()) == best
    assert cliques.clique_check(g, found).first().asDict() == {"cliques": len(best), "not_cliques": 0, "not_maximal": 0, "repeated": 0}
    apart = next(c for c in combinations(ids, 2) if c[1] not in near[c[0]])
    wrong = found.sparkSession.createDataFrame([(list(best[0]),), (list(best[0][:1]),), (list(apart),)], "clique array<bigint>")
    assert cliques.clique_check(g, found.unionByName(wrong)).first().asDict() == {"cliques": len(best) + 3, "not_cliques": 1, "not_maximal": 1, "repeated": 1}
    assert {r.id: r.tri for r in cliques.vertex_triangles(g).collect()} == {v: sum(v in c for c in cl[3]) for v in ids}
    assert [cliques.clique_count(g, 4).first().cliques, cliques.clique_list(g, 4).count()] == [len(cl[4])] * 2
    both = [len(near[a] & near[b]) for a, b in cl[2]]
    diamonds = sum(n * (n - 1) // 2 for n in both)
    assert pattern.count(g, "diamond", False).first().occurrences == diamonds
    assert pattern.count(g, "diamond", True).first().occurrences == diamonds - 6 * len(cl[4])


@pytest.mark.parametrize("step", [1, 10**11])
def test_neighbours_of_groups(spark, cut, step):
    rows = [(g, step * random.Random(g).randrange(30)) for g in range(40) for _ in range(1 + g % 7)] + [(7, None), (None, 3), (99, 5 * step), (99, 5 * step)]
    rows += [(100, step * random.Random(x).randrange(300)) for x in range(120)]
    want = {}
    for a, x in rows:
        for b, y in rows:
            if a is not None and a == b and None not in (x, y) and x != y:
                want.setdefault(x, set()).add(y)
    got = rooted.neighbours(spark.createDataFrame(rows, "g long, i long")).collect()
    assert {r.id: r.nbrs for r in got} == {v: sorted(n) for v, n in want.items()} and len(got) == len(want)
    assert rooted.neighbours(spark.createDataFrame([], "g long, i long")).count() == 0


def test_many_vertices_are_joined(spark, monkeypatch):
    g, near = made(spark, CLOSE)
    monkeypatch.setattr(rooted, "PLACES", 10)
    assert cliques.triangle_total(g).first().triangles == sum(len(near[a] & near[b]) for a in near for b in near[a]) // 6
    assert cliques.maximal_cliques(g, g.vertices.selectExpr("id", "-id AS rank")).count() == cliques.maximal_cliques(g).count()


def test_no_row_is_made_for_an_edge(spark, tmp_path):
    from quarry import registry

    spark.createDataFrame([(o, p) for o in range(50) for p in range(o, o + 6)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("clique_stars", "maximal_cliques", "clique_count_4", "pattern_any_diamond"):
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "sum(n" not in plan.split("MapInArrow", 1)[1]


def test_gaps_give_the_numbers_back_and_take_little_room():
    import zlib

    import numpy as np
    import pyarrow as pa

    far = [5, -3, 2**62, -(2**62), 2**63 - 1, -(2**63), 0]
    for x in (np.array(far), np.array([7, 7, -9, 2**31 - 1, -(2**31)], np.int32), np.zeros(0, np.int32), np.array([3])):
        column = pa.chunked_array([rooted._gaps(x), rooted._gaps(x[::-1].copy())]).combine_chunks()
        there, back = rooted._members(column, x.dtype.type)
        assert (there == x).all() and (back == x[::-1]).all() and there.dtype == x.dtype and len(there) == len(x)
    lists = np.sort(np.random.default_rng(1).integers(0, 1_200_000, 20_000)).astype(np.int32)
    assert len(zlib.compress(rooted._gaps(lists)[0].as_py(), 1)) < 0.6 * len(zlib.compress(lists.tobytes(), 1))


def test_checked_cliques_keep_small_ids(spark, monkeypatch):
    g, _ = made(spark, CLOSE)
    seen, real = [], blocks._paired
    monkeypatch.setattr(blocks, "_paired", lambda rows, *more: (seen.append(dict(rows.dtypes)["id"]), real(rows, *more))[1])
    found = cliques.maximal_cliques(g)
    assert cliques.clique_check(g, found).first().not_cliques == 0
    beyond = found.unionByName(found.sparkSession.createDataFrame([([-(10**12), 5, 10**12],), ([-50, -40],)], "clique array<bigint>"))
    assert cliques.clique_check(g, beyond).first().not_cliques == 2
    assert seen[1] == "int" and seen[-1] == "bigint"


def test_distinct():
    import numpy as np

    for x in ([], [3], [2, 2, 1, 5, 1]):
        assert blocks.distinct(np.array(x, np.int64)).tolist() == sorted(set(x))


@pytest.mark.parametrize("kind", ["int32", "int64"])
def test_squeezed_lists_come_back_and_take_little_room(kind):
    import zlib

    import numpy as np
    import pyarrow as pa

    high = int(np.iinfo(kind).max)
    rows = [[], [5], [-high - 1, high, 0, -3], [], [2, 2, 9], [*range(100, 1000, 7)], []]
    for a, b in ((0, 7), (1, 3), (3, 4), (2, 7), (0, 1), (3, 3)):
        raws = blocks._squeezed(pa.array(rows, pa.list_(getattr(pa, kind)()))[a:b])
        size, flat = blocks._members(raws, np.dtype(kind))
        assert size.tolist() == [len(x) for x in rows[a:b]] and flat.tolist() == sum(rows[a:b], []) and flat.dtype == kind
        if b - a > 2:
            size, flat = blocks._members(raws[1:-1], np.dtype(kind))
            assert flat.tolist() == sum(rows[a + 1 : b - 1], []) and size.tolist() == [len(x) for x in rows[a + 1 : b - 1]]
    lists = [np.sort(x).astype(kind) for x in np.random.default_rng(1).integers(0, 1_200_000, (500, 50))]
    raw = blocks._squeezed(pa.array(lists)).buffers()[2].to_pybytes()
    assert len(zlib.compress(raw, 1)) < 0.75 * len(zlib.compress(np.concatenate(lists).tobytes(), 1))
