"""Peeling by one task with members in a file: equal to rounds over tables, and one write of the result whatever the rounds."""

import random
from itertools import combinations

import pytest

from quarry.operators import order, peel, traverse
from quarry.operators.graph import Graph
from tests.test_pairs import FAR_IDS, NEAR_IDS


def _graph(spark, ids):
    half = random.Random(8).sample(list(combinations(ids[:25], 2)), 150) + random.Random(9).sample(list(combinations(ids, 2)), 80)
    return Graph.from_edges(spark.createDataFrame(half, "src long, dst long"), spark.createDataFrame([(v,) for v in [*ids, 10**6 + 1]], "id long")).kept()


@pytest.mark.parametrize("ids, work", [(NEAR_IDS, 7), (FAR_IDS, 10**6)])
def test_cores_in_a_file_equal_rounds(spark, monkeypatch, ids, work):
    monkeypatch.setattr(peel, "WORK", work)
    g = _graph(spark, ids)
    want = {r.id: r.core for r in order.core_numbers(g, tail=0).collect()}
    monkeypatch.setattr(order, "rounds", None)
    assert {r.id: r.core for r in order.core_numbers(g).collect()} == want and len(set(want.values())) > 2


@pytest.mark.parametrize("boundary", [order.average_boundary, order.min_boundary, order.sampled_min_boundary, order.sampled_median_boundary])
def test_approximate_orders_in_one_task_equal_rounds(spark, monkeypatch, boundary):
    g = _graph(spark, FAR_IDS if boundary in (order.average_boundary, order.min_boundary) else NEAR_IDS)
    want = {r.id: r["rank"] for r in order.approximate(g, boundary=boundary, tail=0).collect()}
    monkeypatch.setattr(order, "rounds", None)  # a job or more for each round
    assert {r.id: r["rank"] for r in order.approximate(g, boundary=boundary).collect()} == want and len(want) == 41


def test_a_graph_of_nothing_is_peeled(spark):
    g = Graph(spark.createDataFrame([], "src long, dst long"))
    assert order.core_numbers(g).count() == 0 == order.approximate(g).count()


@pytest.mark.parametrize("ids, work", [(NEAR_IDS, 7), (FAR_IDS, 10**6)])
def test_ranks_and_components_in_one_task_equal_rounds(spark, monkeypatch, ids, work):
    monkeypatch.setattr(peel, "WORK", work)
    pairs = random.Random(4).sample([(a, b) for a in ids for b in ids if a != b], 60)
    arcs = spark.createDataFrame(pairs, "src long, dst long")
    path = list(zip(ids[::3], ids[3::3])) + [(ids[1], ids[4]), (ids[2], ids[5])]
    g = Graph.from_edges(spark.createDataFrame(path, "src long, dst long"), spark.createDataFrame([(v,) for v in ids], "id long")).kept()
    for options in ({"tolerance": None}, {"tolerance": 1e-3, "iterations": 50}):
        want = {r.id: r["rank"] for r in traverse.pagerank(arcs, tail=0, **options).collect()}
        got = {r.id: r["rank"] for r in traverse.pagerank(arcs, **options).collect()}
        assert got == pytest.approx(want, abs=1e-12) and len(got) > 30
    labels = {r.id: r.component for r in traverse.components(g, tail=0).collect()}
    monkeypatch.setattr(traverse, "connected", None)
    assert {r.id: r.component for r in traverse.components(g).collect()} == labels and len(labels) == 40


def test_one_task_takes_all_of_a_long_path(spark):
    path = list(range(1000))
    random.Random(1).shuffle(path)
    g = Graph.from_edges(spark.createDataFrame(list(zip(path, path[1:])), "src long, dst long"))
    assert {r.component for r in traverse.components(g).collect()} == {0}
