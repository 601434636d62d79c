"""Graph queries read all lines of the table; those slow on the tables of test_oracles.py are compared with brute force and their SQL here."""

from itertools import combinations, permutations

import pytest

from quarry import registry
from quarry.sources.graphs import part_graph
from tests.helpers import duck, rows_of
from tests.test_oracles import SLOW

ORDERS = [(1, 2, 3, 4, 5, 6), (2, 3, 7), (5, 8), (8, 9), (9, 5), (10,), (1, 7)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Orders of parts whose lines have all three flags, no two lines of an order the flag R; part 11 is in no order."""
    folder = str(tmp_path_factory.mktemp("small"))
    lines = [(o, p, "R" if i == 0 else "AN"[i % 2]) for o, items in enumerate(ORDERS) for i, p in enumerate(items)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in range(1, 12)], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    return folder


HALF = {frozenset(x) for items in ORDERS for x in combinations(items, 2)}
NEAR = {v: {w for e in HALF if v in e for w in e - {v}} for v in range(1, 12)}


def cliques(k):
    return [c for c in combinations(range(1, 12), k) if all(frozenset(x) in HALF for x in combinations(c, 2))]


def maximal(ids):
    return [c for k in range(1, 12) for c in cliques(k) if set(c) <= ids and not set.intersection(*[NEAR[v] for v in c])]


def cycles(induced):
    ring = [(0, 1), (1, 2), (2, 3), (3, 0)]
    linked = lambda t, i, j: frozenset((t[i], t[j])) in HALF
    return sum(all(linked(t, *x) for x in ring) and not (induced and (linked(t, 0, 2) or linked(t, 1, 3))) for t in permutations(range(1, 12), 4))


def brute(name):
    if name == "clique_count_by_order":
        return [(o, 4, len(cliques(4)), 24 * len(cliques(4))) for o in ("identity", "random", "degree", "degeneracy", "approximate")]
    if name.startswith("clique_count"):
        k = int(name[-1])
        return [(k, len(cliques(k)), len(cliques(k)) * {4: 24, 5: 120, 6: 720}[k])]
    found = maximal({v for v in NEAR if NEAR[v] or name == "maximal_cliques_with_isolated"})
    if name == "maximal_clique_sizes":
        return [(k, n) for k in range(1, 12) if (n := sum(len(c) == k for c in found))]
    return [(len(found), 0, 0, 0)] if name == "maximal_cliques_by_degeneracy" else [(",".join(map(str, c)),) for c in found]


@pytest.mark.parametrize("name", sorted(SLOW | {"clique_count_5", "clique_count_6", "clique_count_by_order"}))
def test_against_brute_force_and_sql(spark, small, name):
    df = registry.queries()[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    assert sorted(rows) == sorted(brute(name))
    cur = duck(small).execute(registry.oracle_sql()[name])
    assert rows_of(df.columns, rows) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("induced", [True, False])
def test_four_cycles_are_counted(spark, small, induced):
    n = cycles(induced)
    assert [tuple(r) for r in registry.queries()[f"pattern_{'induced' if induced else 'any'}_cycle4"](spark, small).collect()] == [("cycle4", induced, n, n // 8)]


def test_edges_are_of_all_lines(spark, small):
    assert {frozenset(r) for r in registry.queries()["edge_list"](spark, small).collect()} == HALF
    assert part_graph(spark, small, flag="R").half.count() == 0
    assert not any("l_returnflag" in q for q in registry.oracle_sql().values())
