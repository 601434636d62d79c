import os

import pytest

from quarry import registry
from tests.helpers import check

ORACLE = registry.oracle_sql()
#: Their SQL takes about 16 s on the dense graph of the smallest tables: tests/test_whole_graph.py runs them on a small one.
SLOW = {"maximal_cliques", "maximal_cliques_by_level", "maximal_cliques_with_isolated", "maximal_clique_sizes", "maximal_cliques_by_degeneracy"}


@pytest.mark.parametrize("name", [n for n in ORACLE if n not in SLOW])
def test_query_equals_sql(spark, name):
    assert check(spark, registry.queries()[name], ORACLE[name]) >= 0


def test_entry_works_without_the_llm_folder():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for top, _, files in os.walk(os.path.join(here, "quarry")):
        if "llm" not in top:
            for f in files:
                if f.endswith(".py"):
                    assert "quarry.llm" not in open(os.path.join(top, f)).read()


def test_flagship(spark):
    rows = registry.flagship(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 10 and rows[0].tri >= rows[-1].tri
