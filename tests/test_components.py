import random

import pytest

from quarry.operators.components import components

N = 1000


def shuffled(n, seed):
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


@pytest.mark.parametrize("path", [shuffled(N, 1), [0, *range(N - 1, 0, -1)]], ids=["shuffled", "falling"])
def test_long_paths_have_one_label(spark, path):
    edges = spark.createDataFrame(list(zip(path, path[1:])) + [(N + 1, N), (N + 2, N + 2)], "src long, dst long")
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == dict.fromkeys(range(N), 0) | {N: N, N + 1: N, N + 2: N + 2}
