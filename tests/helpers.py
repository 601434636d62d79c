"""Compare a query with DuckDB SQL on the same tables: columns by name, rows as a multiset."""

import glob
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _cell(x):
    return round(x, 9) if isinstance(x, float) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def check(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    extra, missing = ours - theirs, theirs - ours
    assert not extra and not missing, (sum(extra.values()), sum(missing.values()), list(extra)[:3], list(missing)[:3])
    return sum(ours.values())
