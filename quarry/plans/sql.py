"""SQL for DuckDB that the queries' oracles share."""

from __future__ import annotations


#: Half edges between parts bought in one order.
PAIRS = """SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst
  FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey"""


DERIVED = """e AS MATERIALIZED (SELECT src, dst FROM half UNION ALL SELECT dst, src FROM half
), deg AS MATERIALIZED (SELECT src AS id, count(*)::BIGINT AS degree FROM e GROUP BY 1
), adj AS MATERIALIZED (SELECT src AS id, list(dst ORDER BY dst) AS nbrs FROM e GROUP BY 1)"""


def using(body: str, recursive: bool = False) -> str:
    """A query over CTEs half(src, dst), e(src, dst) in both directions, deg(id, degree) and adj(id, nbrs); body starts with further CTEs (", name AS ...") or with SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}half AS MATERIALIZED ({PAIRS}), {DERIVED}{body}"


def text(array: str) -> str:
    return f"array_to_string({array}, ',')"


CORES = """
, core(id, k, round) AS (
  SELECT id, degree, 0 FROM deg
  UNION ALL
  SELECT id, max(least(rn, k))::BIGINT, max(round) + 1 FROM (
    SELECT e.src AS id, c.k, c.round, row_number() OVER (PARTITION BY e.src ORDER BY c.k DESC) AS rn FROM e JOIN core c ON c.id = e.dst
  ) WHERE round < 40 GROUP BY id
), cores AS MATERIALIZED (SELECT id, k AS core FROM core WHERE round = 40)"""
