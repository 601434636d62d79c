import pytest

from quarry.operators import color, order
from quarry.operators.graph import Graph


@pytest.mark.parametrize("run", [lambda g: order.core_numbers(g, 1, tail=0), lambda g: color.by_priority(g, g.vertices.selectExpr("id", "id AS p1", "0 AS p2"), max_rounds=1, tail=0), lambda g: color.johansson(g, max_rounds=0)])
def test_a_bound_met_with_work_left_raises(spark, run):
    path = Graph.from_edges(spark.createDataFrame([(i, i + 1) for i in range(11)], "src long, dst long"))
    with pytest.raises(RuntimeError, match="not done"):
        run(path)


def test_without_a_bound_loops_end(spark):
    path = Graph.from_edges(spark.createDataFrame([(i, i + 1) for i in range(11)], "src long, dst long"))
    assert {r.core for r in order.core_numbers(path, tail=0).collect()} == {1} == {r.core for r in order.core_numbers(path).collect()}
    assert color.greedy(path).count() == 12 == color.johansson(path).count()


@pytest.mark.parametrize("tail", [0, 40, 10_000])
def test_priority_colours_do_not_depend_on_the_tail(spark, tail):
    pairs = [(i, (i * k + 1) % 60) for i in range(60) for k in (3, 7)]
    g = Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"))
    near = {v: {w for e in pairs if v in e for w in e if w != v} for v in range(60)}
    fixed, want = {5: 9, 6: 2}, {}
    want |= fixed
    for v in sorted(set(range(60)) - set(fixed), key=lambda v: (v % 10, v), reverse=True):
        used = {want[w] for w in near[v] if w in want}
        want[v] = next(c for c in range(1, 99) if c not in used)
    colored = spark.createDataFrame(list(fixed.items()), "id long, color long")
    found = color.by_priority(g, g.vertices.selectExpr("id", "id % 10 AS p1", "id AS p2"), colored, tail=tail)
    assert {r.id: r.color for r in found.collect()} == want


def test_core_numbers_by_rounds_equal_peeling(spark):
    pairs = [(i, (i * k + 1) % 60) for i in range(60) for k in (3, 7, 11) if i % 4 or k == 3]
    g = Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"))
    by_rounds, peeled = ({r.id: r.core for r in order.core_numbers(g, tail=t).collect()} for t in (0, 10_000))
    assert by_rounds == peeled and len(set(peeled.values())) > 1
